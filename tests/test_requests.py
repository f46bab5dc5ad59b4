"""Request bodies, transcripts and canonical JSON against small fixtures and plain Python."""

import json
import math

from pyspark.sql import functions as F

from decisa.functions import jsons
from decisa.operators import requests as R
from decisa.operators import transcripts as T


def test_canonical_json_and_keys(spark):
    texts = ['{"b": 1, "a": [true, null, {"z": "x", "é": "\\u00e9\\n\\"q\\":"}]}', '{"a":1,"a":2}', "NaN", '{"a": NaN}', "{", "", None, '[1, -2.5, 12345678901]', '"x"', '{"a": 1}}', '{"a": 1} 2', '[1] "b"', '{":k": "a", "v": "\\":", "w\\"x": {"k": {}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["c"], r["k"], r["h"]) for r in df.select("i", jsons.canonical(F.col("t")).alias("c"), jsons.keys(F.col("t")).alias("k"), jsons.has_any_key(F.col("t"), ["z", "k"]).alias("h")).collect()}

    def all_keys(x):
        return [k for a, b in sorted(x.items()) for k in (a, *all_keys(b))] if isinstance(x, dict) else [k for y in x for k in all_keys(y)] if isinstance(x, list) else []

    for i, t in enumerate(texts):
        if i in (1, 2, 3, 4, 5, 6, 9, 10, 11):
            assert got[i] == (None, None, None), t
        else:
            x = json.loads(t)
            assert got[i][0] == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            assert got[i][1] == all_keys(x) and got[i][2] == bool({"z", "k"} & set(all_keys(x)))


def test_canonical_numbers_and_key_order(spark):
    cases = [
        ("[100.0]", "[100.0]"), ("[100]", "[100]"), ("[-0.0]", "[-0.0]"), ("[-0]", "[0]"), ("[1E-7]", "[1e-07]"), ("[1e+16,1E22,1.50]", "[1e+16,1e+22,1.5]"), ("[" + "1234567890" * 5 + "]", "[" + "1234567890" * 5 + "]"),
        ('{"\U0001f600":1,"\uffee":2,"b":3}', '{"b":3,"\uffee":2,"\U0001f600":1}'), ('["\\u00e9\\/"]', '["é/"]'), ("[1e400]", None), ('["\\ud800"]', None), ("[" * 100_000 + "]" * 100_000, None), ("[01]", None), ("\ufeff[]", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert {r["i"]: r["c"] for r in df.select("i", jsons.canonical(F.col("t")).alias("c")).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    assert len({r[0] for r in df.filter("i < 3").select(jsons.identity(F.col("t"))).collect()}) == 3


def chat(*messages, **more):
    return json.dumps({"model": "m", "messages": list(messages), **more})


U, A = {"role": "user", "content": "ask"}, {"role": "assistant", "content": "say"}
CALL = {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "type": "function"}]}
ANSWER = {"role": "tool", "tool_call_id": "c1", "content": "out"}
PARTS = [{"type": "text", "text": "one"}, {"type": "tool_use", "id": "t1", "name": "x"}]
RESULT = {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "r"}, {"type": "text", "text": "two"}]}
CASES = [
    ("fine", "openai_chat", chat(U, A), None, ["/messages/0/content", "/messages/1/content"]),
    ("system", "openai_chat", chat({"role": "system", "content": "s"}, U, tools=[1], metadata={}), None, ["/tools", "/metadata", "/messages/0/content", "/messages/1/content"]),
    ("tools", "openai_chat", chat(U, CALL, ANSWER), None, ["/messages/0/content", "/messages/1/tool_calls", "/messages/2/tool_call_id", "/messages/2/content"]),
    ("parts", "anthropic_messages", chat(U, {"role": "assistant", "content": PARTS}, RESULT, system="s"), None, ["/system", "/messages/0/content", "/messages/1/content/0/text", "/messages/1/content/1", "/messages/2/content/0", "/messages/2/content/1/text"]),
    ("text", "openai_responses", json.dumps({"input": "hello", "instructions": "i"}), None, ["/instructions", "/input"]),
    ("items", "openai_responses", json.dumps({"input": [{"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}]}), None, ["/input/0/content/0/text"]),
    ("format", "other", chat(U), "unsupported_format", []),
    ("big", "openai_chat", chat({"role": "user", "content": "x" * 128_000}), "request_budget_exceeded", []),
    ("broken", "openai_chat", chat(U)[:-1], "invalid_json", []),
    ("repeated key", "openai_chat", '{"messages":[],"messages":[]}', "invalid_json", []),
    ("null", "openai_chat", None, "invalid_json", []),
    ("list", "openai_chat", "[1]", "invalid_envelope", []),
    ("field", "openai_chat", chat(U, zzz=1), "unsupported_envelope_fields", []),
    ("server", "openai_responses", json.dumps({"input": "x", "previous_response_id": "r"}), "unresolved_server_context", []),
    ("no server", "openai_responses", json.dumps({"input": "x", "previous_response_id": None, "prompt": ""}), None, ["/input"]),
    ("empty", "openai_chat", chat(), "invalid_messages", []),
    ("no messages", "openai_chat", '{"model":"m"}', "invalid_messages", []),
    ("orphan", "openai_chat", chat(U, ANSWER), "unresolved_tool_link", []),
    ("pending", "openai_chat", chat(U, CALL), "unresolved_tool_link", []),
    ("early", "openai_chat", chat(ANSWER, CALL), "unresolved_tool_link", []),
    ("not object", "openai_chat", chat(U, 5), "invalid_message", []),
    ("message field", "openai_chat", chat({**U, "weird": 1}), "unsupported_message_fields", []),
    ("item", "openai_responses", json.dumps({"input": [{"type": "reasoning", "role": "user", "content": "x"}]}), "unsupported_response_item", []),
    ("role", "anthropic_messages", chat({"role": "system", "content": "s"}), "unsupported_role", []),
    ("content", "openai_chat", chat({"role": "user", "content": [{"type": "image"}]}), "unsupported_content", []),
    ("nothing", "openai_chat", chat({"role": "user", "content": []}), "unsupported_content", []),
    ("many", "openai_chat", chat(*[U] * 129), "segment_budget_exceeded", []),
    ("user calls", "openai_chat", chat({**CALL, "role": "user"}, ANSWER), "unresolved_tool_link", []),
    ("calls null", "openai_chat", chat(U, {**A, "tool_calls": None}), "unresolved_tool_link", []),
    ("calls object", "openai_chat", chat(U, {**A, "tool_calls": {"id": "c"}}), "unresolved_tool_link", []),
    ("no calls", "openai_chat", chat(U, {**A, "tool_calls": []}), None, ["/messages/0/content", "/messages/1/tool_calls", "/messages/1/content"]),
    ("nameless call", "openai_chat", chat(U, {**CALL, "tool_calls": [{"id": "c1"}, {"id": 3}]}, ANSWER), "unresolved_tool_link", []),
    ("call twice", "openai_chat", chat(U, CALL, ANSWER, CALL, ANSWER), "unresolved_tool_link", []),
    ("answer twice", "openai_chat", chat(U, CALL, ANSWER, ANSWER), "unresolved_tool_link", []),
    ("assistant answers", "anthropic_messages", chat(U, {"role": "assistant", "content": PARTS}, {**RESULT, "role": "assistant"}), "unresolved_tool_link", []),
    ("user uses", "anthropic_messages", chat({"role": "user", "content": PARTS}, RESULT), "unresolved_tool_link", []),
    ("legacy", "openai_chat", chat(U, {**A, "function_call": {"name": "f"}}), "unsupported_legacy_tool_call", []),
    ("legacy first", "openai_chat", chat({**A, "function_call": {"name": "f"}}, 5), "unsupported_legacy_tool_call", []),
    ("no legacy", "openai_chat", chat(U, {**A, "function_call": None}), None, ["/messages/0/content", "/messages/1/function_call", "/messages/1/content"]),
    ("surrogate", "openai_chat", '{"messages":[{"role":"user","content":"\\ud800"}]}', "invalid_json", []),
    ("pair", "openai_chat", '{"messages":[{"r\\u006fle":"us\\u0065r","content":"\\ud83d\\ude00\\n"}]}', None, ["/messages/0/content"]),
    ("control character", "openai_chat", '{"messages":[{"role":"user","content":"a\tb"}]}', "invalid_json", []),
    ("infinite", "openai_chat", '{"n":1e999,"messages":[{"role":"user","content":"x"}]}', "invalid_json", []),
    ("part field", "openai_chat", chat({"role": "user", "content": [{"type": "text", "text": "x", "zzz": 1}]}), "unsupported_content_fields", []),
    ("image result", "anthropic_messages", chat(U, {"role": "assistant", "content": PARTS}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}, {"type": "image"}]}]}), "unsupported_content", []),
    ("text result", "anthropic_messages", chat(U, {"role": "assistant", "content": PARTS}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}]}]}), None, ["/messages/0/content", "/messages/1/content/0/text", "/messages/1/content/1", "/messages/2/content/0"]),
    ("cited", "openai_chat", chat({"role": "assistant", "content": [{"type": "text", "text": "x", "citations": [1], "annotations": []}, {"type": "text", "text": "y"}]}, U), None, ["/messages/0/content/0/text", "/messages/0/content/0/citations", "/messages/0/content/0/annotations", "/messages/0/content/1/text", "/messages/1/content"]),
    ("object content", "openai_chat", chat({"role": "user", "content": {"type": "text"}}), "unsupported_content", []),
    ("first of two", "openai_chat", chat({"role": "user", "content": 3}, {**U, "weird": 1}), "unsupported_content", []),
    ("role kind", "openai_chat", chat({"role": 5, "content": "x"}), "unsupported_role", []),
    ("messages object", "openai_chat", '{"messages":{"0":{"role":"user","content":"x"}}}', "invalid_messages", []),
]


def test_request_reasons_and_segments(spark):
    df = spark.createDataFrame([(n, f, raw) for n, f, raw, _, _ in CASES], "name string, wire string, raw string")
    parsed = R.parsed_requests(df, "name", "raw", "wire")
    got = {r["name"]: (r["reason"], [s["pointer"] for s in r["segments"]]) for r in parsed.collect()}
    assert got == {n: (reason, pointers) for n, _, _, reason, pointers in CASES}
    rows = {(r["name"], r["pointer"]): r for r in R.wire_segments(parsed, "name").collect()}
    assert rows[("fine", "/messages/1/content")]["text"] == "say" and not rows[("fine", "/messages/1/content")]["protected"]
    assert rows[("parts", "/messages/1/content/0/text")]["protected"] and rows[("parts", "/messages/1/content/1")]["role"] == "control"
    assert rows[("cited", "/messages/0/content/0/text")]["protected"] and not rows[("cited", "/messages/0/content/1/text")]["protected"]
    bodies = {n: raw for n, _, raw, _, _ in CASES}
    for (name, pointer), r in rows.items():
        value = json.loads(bodies[name])
        for step in pointer.split("/")[1:]:
            value = value[int(step)] if isinstance(value, list) else value[step]
        assert json.loads(bodies[name].encode()[r["start"] : r["stop"]]) == value and r["text"] in (None, value)
    assert R.parsed_requests(df.limit(0), "name", "raw", "wire").collect() == []
    twice = df.filter("name = 'fine'").unionAll(df.filter("name = 'fine'")).select(F.lit(None).cast("string").alias("name"), "raw", "wire")
    assert [(r["name"], len(r["segments"])) for r in R.parsed_requests(twice, "name", "raw", "wire").collect()] == [(None, 2)] * 2


def test_score_contract(spark):
    p = lambda x: {"false": 1 - x, "true": x}
    cases = [(None, "wrong_ids"), ({"a": p(0.2)}, "wrong_ids"), ({"a": p(0.2), "b": p(0.9)}, None), ({"a": p(0.2), "b": {"true": 1.0}}, "wrong_labels"), ({"a": p(0.2), "b": {"true": math.nan, "false": 0.0}}, "not_finite"), ({"a": p(0.2), "b": {"true": None, "false": 0.0}}, "not_finite"), ({"a": p(2.0), "b": p(0.1)}, "out_of_range"), ({"a": {"true": 0.5, "false": 0.4}, "b": p(0.1)}, "wrong_sum")]
    df = spark.createDataFrame([(i, ["b", "a"], c) for i, (c, _) in enumerate(cases)], "i int, ids array<string>, answers map<string, map<string, double>>")
    assert {r["i"]: r["r"] for r in df.select("i", R.score_reason(F.col("ids"), F.col("answers")).alias("r")).collect()} == {i: r for i, (_, r) in enumerate(cases)}


def test_shadow_gate(spark):
    body = chat({"role": "system", "content": "s"}, U, A, {"role": "assistant", "content": "old"}, {"role": "assistant", "content": "base"}, {"role": "assistant", "content": "deep"})
    df = spark.createDataFrame([("r", "openai_chat", body), ("silent", "openai_chat", chat(A, A)), ("bad", "openai_chat", "{")], "name string, wire string, raw string")
    at = lambda i: f"/messages/{i}/content"
    scores = [("r", at(2), 0.5), ("r", at(3), 0.999), ("r", at(4), 0.999), ("r", at(5), 1.0), ("r", at(1), 1.0), ("silent", at(0), 1.0)]
    needs = [("r", at(2), at(4)), ("r", at(4), at(5)), ("r", at(3), at(5))]
    got = R.shadow_gate(R.parsed_requests(df, "name", "raw", "wire"), spark.createDataFrame(scores, "name string, pointer string, p double"), spark.createDataFrame(needs, "name string, pointer string, needs string"), "name")
    rows = {(r["name"], r["pos"]): (r["suggestion"], r["reason"]) for r in got.collect()}
    assert rows == {("r", 0): ("retain", "protected"), ("r", 1): ("retain", "protected"), ("r", 2): ("retain", "uncertain_score"), ("r", 3): ("drop", "high_irrelevance_score"), ("r", 4): ("retain", "dependency"), ("r", 5): ("retain", "dependency"), ("silent", 0): ("retain", "missing_user_intent"), ("silent", 1): ("retain", "missing_user_intent")}


def event(type_, content, **more):
    return json.dumps({"type": type_, "message": {"content": content}, **more})


LINES = [
    event("user", "hello"), event("user", "  <command-name>x"), event("user", " \n"), event("assistant", [{"type": "text", "text": "hi"}, {"type": "thinking", "text": "no"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "./src/a.py"}}]),
    event("user", [{"type": "tool_result", "content": [{"type": "text", "text": "l1"}, {"type": "text", "text": "l2"}]}, {"type": "text", "text": "next"}]), event("user", "meta", isMeta=True), event("assistant", [{"type": "text", "text": "sum"}], isCompactSummary=True), event("user", "sys", promptSource="system"),
    "not json", json.dumps({"type": "other"}), event("assistant", "plain"), event("user", [{"type": "tool_result", "content": {"b": 1, "a": 2}}]),
]


def test_transcripts_are_flattened(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(LINES)] + [("many", i, event("user", "x")) for i in range(5)], "session string, seq int, line string")
    rows = T.transcript_segments(df, "session", "seq", "line", most=6).orderBy("place").collect()
    want = [("user_turn", "hello"), ("assistant_text", "hi"), ("tool_use", '{"tool_use":{"input":{"file_path":"./src/a.py"},"name":"Read"}}'), ("tool_result", "l1\nl2"), ("user_turn", "next"), ("tool_result", '{"a":2,"b":1}')]
    assert [(r["kind"], r["text"]) for r in rows if r["session"] == "s"] == want and [r["place"] for r in rows if r["session"] == "s"] == list(range(6))
    assert T.transcript_segments(df, "session", "seq", "line", most=5).filter("session = 's'").count() == 0
    assert T.transcript_segments(df, "session", "seq", "line", most_bytes=5).select("session").distinct().collect()[0][0] == "many"


def test_tool_operations(spark):
    call = lambda name, input_: json.dumps({"tool_use": {"name": name, "input": input_}})
    cases = [
        (call("Read", {"file_path": " ./a/b.py "}), [("read", ["a/b.py"])]), (call("Edit", {"path": "/x/y"}), [("edit", ["x/y"])]), (call("Glob", {"pattern": "src/lib/x"}), [("list", ["src/lib/x"])]),
        (call("bash", "cat src/a.py && ls src/lib/x"), [("read", ["src/a.py", "src/lib/x"]), ("list", ["src/a.py", "src/lib/x"])]),
        (call("shell", "apply_patch *** Update File: src/p.py\ncat src/q.py"), [("edit", ["src/p.py"]), ("read", ["src/q.py"])]), (call("grep", {"path": "a/b"}), []), (call("unknown", {"path": "a/b"}), []),
        ("text", []), (None, []), ('{"tool_use": 3}', []), (call("bash", "echo hi"), []), (call(None, "head a/b"), [("read", ["a/b"])]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r["i"]: [(o["op"], o["paths"]) for o in r["ops"]] for r in df.select("i", T.tool_ops(F.col("c")).alias("ops")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_rereads_stitches_and_contrasts(spark):
    call = lambda name, path: json.dumps({"tool_use": {"name": name, "input": {"path": path}}})
    calls = [("read", "a/x"), ("read", "a/x"), ("edit", "a/x"), ("read", "a/x"), ("read", "b/y"), ("edit", "c/z")]
    seg = spark.createDataFrame([("s", i, "tool_use", call(*c)) for i, c in enumerate(calls)], "session string, place int, kind string, text string")
    got = sorted((r["place"], r["strategy"], r["label"], r["evidence"]) for r in T.mined_rereads(seg, "session").collect())
    assert got == [(0, "stale_read", "drop", 2), (1, "stale_read", "drop", 2), (3, "wanted_read", "keep", None), (4, "wanted_read", "keep", None)]
    noise = spark.createDataFrame([("s", 1, "n1"), ("s", 1, "n0"), ("s", 99, "end"), ("other", 0, "x")], "session string, at int, text string")
    rows = T.stitched(spark.createDataFrame([("s", i, f"t{i}") for i in range(3)], "session string, place int, text string"), noise, "session").orderBy("place").collect()
    assert [(r["text"], r["inserted"]) for r in rows] == [("t0", False), ("n0", True), ("n1", True), ("t1", False), ("t2", False), ("end", True)]
    segs = spark.createDataFrame([("a", 0, "same"), ("b", 0, "same"), ("c", 0, "own"), ("d", 0, "same")], "k string, place int, text string")
    labels = spark.createDataFrame([("a", 0, 1), ("b", 0, 0), ("c", 0, 1)], "k string, place int, label int")
    assert sorted((r["k"], r["label"]) for r in T.contrast_records(segs, "k", "place", "text", labels).collect()) == [("a", 1), ("b", 0)]


def item(type_, **payload):
    return json.dumps({"type": "response_item", "payload": {"type": type_, **payload}})


def part(text, type_="input_text"):
    return {"type": type_, "text": text}


def test_response_items_and_dropped_transcripts(spark):
    lines = [
        item("message", role="user", content=[part(" <environment_context>x"), part("hello"), part("there"), part(" "), part("pic", "other")]), item("message", role="user", content=[part("# AGENTS.md instructions")]),
        item("message", role="assistant", content=[part("<image>")]), item("message", role="assistant", content=[part("say", "output_text"), part("<turn_aborted>")]), item("message", role="developer", content=[part("no")]),
        item("function_call", name="shell", arguments='{"a":1}'), item("custom_tool_call", name="p", input="x"), item("function_call_output", output={"b": 2, "a": 1}), item("custom_tool_call_output", output="done"),
        item("web_search_call", action={"q": "z"}), item("image_generation_call", revised_prompt="cat"), item("reasoning", content="hidden"), json.dumps({"type": "other", "payload": {"type": "message"}}), "broken", json.dumps({"type": "response_item", "payload": 3}),
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)] + [("quiet", 0, "{}"), ("bytes", 0, item("function_call_output", output="y" * 200)), ("bytes", 1, item("function_call_output", output="z"))], "session string, seq int, line string")
    got = T.transcript_segments(df, "session", "seq", "line", most_bytes=150, grammar="responses").orderBy("place").collect()
    want = [
        ("user_turn", "hello\n\nthere"), ("assistant_text", "<image>"), ("assistant_text", "say"), ("tool_use", '{"tool_use":{"input":"{\\"a\\":1}","name":"shell"}}'), ("tool_use", '{"tool_use":{"input":"x","name":"p"}}'), ("tool_result", '{"a":1,"b":2}'),
        ("tool_result", "done"), ("tool_use", '{"tool_use":{"input":{"q":"z"},"name":"web_search"}}'), ("tool_use", '{"tool_use":{"input":"cat","name":"image_generation"}}'),
    ]
    total = sum(len(t) for _, t in want)
    assert got == [] and total > 150
    got = T.transcript_segments(df, "session", "seq", "line", most_bytes=1000, grammar="responses").filter("session = 's'").orderBy("place").collect()
    assert [(r["kind"], r["text"]) for r in got] == want and [r["place"] for r in got] == list(range(9))
    dropped = lambda **limits: {(r["session"], r["reason"], r["place"]) for r in T.dropped_transcripts(df, "session", "seq", "line", grammar="responses", **limits).collect()}
    assert dropped() == {("quiet", "no_segments", None)}
    assert dropped(most=4) == {("quiet", "no_segments", None), ("s", "segment_count_hard_cap", 4)}
    assert dropped(most_bytes=199, most=1) == {("quiet", "no_segments", None), ("bytes", "extracted_text_over_cap", 0), ("s", "segment_count_hard_cap", 1)}
