"""The active gate against plain Python."""

import hashlib
import json

from decisa.operators import gate, removal
from pyspark.sql import functions as F

U, A = {"role": "user", "content": "ask"}, {"role": "assistant", "content": "say"}
AT = "/messages/{}/content"


def body(*messages, **more):
    return json.dumps({"model": "m", "messages": list(messages), **more}, indent=1)


def notes(**by_index):
    return json.dumps({"segments": {AT.format(k[1:]): v for k, v in by_index.items()}})


YES = {"eligible": True}
LONG = body(U, *[{"role": "assistant", "content": f"a{k}"} for k in range(70)])
ALL = json.dumps({"segments": {AT.format(k): YES for k in range(1, 71)}})
OLD, NEW = {"role": "assistant", "content": "old"}, {"role": "assistant", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}
PART = "/messages/{}/content/{}/text"
# name, body, policy, scores by pointer, status, reason, reasons of segments, pointers cut
CASES = [
    ("cut", body(U, OLD, A, U), notes(i1=YES, i2=YES), {AT.format(1): 1.0, AT.format(2): 0.5}, "scored", "shadow_only", ["protected_structure", "high_irrelevance_score", "uncertain_score", "protected_structure"], [1]),
    ("retain", body(U, OLD), notes(i1=YES), {AT.format(1): 0.001}, "scored", "shadow_only", ["protected_structure", "model_retain"], []),
    ("not eligible", body(U, OLD, A), notes(i1=YES), {AT.format(1): 1.0, AT.format(2): 1.0}, "scored", "shadow_only", ["protected_structure", "high_irrelevance_score", "not_explicitly_eligible"], [1]),
    ("flagged", body(U, OLD, A), notes(i1={"eligible": True, "pinned": True}, i2=YES), {AT.format(2): 1.0}, "scored", "shadow_only", ["protected_structure", "caller_protected", "high_irrelevance_score"], [2]),
    ("needed", body(U, OLD, OLD, A), notes(i1=YES, i2={"eligible": True, "depends_on": [AT.format(1)]}, i3={"depends_on": [AT.format(2)]}), {}, "bypass", "no_eligible_segments", ["protected_structure", "required_dependency", "required_dependency", "not_explicitly_eligible"], []),
    ("needed late", body(U, OLD, OLD, A), notes(i1=YES, i2={"eligible": True, "depends_on": [AT.format(1)]}, i3=YES), {AT.format(1): 1.0, AT.format(2): 0.6, AT.format(3): 1.0}, "scored", "shadow_only", ["protected_structure", "required_dependency", "uncertain_score", "high_irrelevance_score"], [3]),
    ("null policy", body(U, OLD), None, {AT.format(1): 1.0}, "bypass", "no_eligible_segments", ["protected_structure", "not_explicitly_eligible"], []),
    ("list policy", body(U, OLD), "[]", {}, "bypass", "invalid_sidecar", ["whole_request_fallback"] * 2, []),
    ("broken policy", body(U, OLD), "{", {}, "bypass", "invalid_sidecar", ["whole_request_fallback"] * 2, []),
    ("policy field", body(U, OLD), '{"zzz":1}', {}, "bypass", "invalid_sidecar", ["whole_request_fallback"] * 2, []),
    ("flag kind", body(U, OLD), notes(i1={"eligible": 1}), {}, "bypass", "invalid_sidecar", ["whole_request_fallback"] * 2, []),
    ("note field", body(U, OLD), notes(i1={"zzz": True}), {}, "bypass", "invalid_sidecar", ["whole_request_fallback"] * 2, []),
    ("note kind", body(U, OLD), notes(i1=[]), {}, "bypass", "invalid_sidecar", ["whole_request_fallback"] * 2, []),
    ("bypass", body(U, OLD), '{"bypass":true,"segments":{}}', {}, "bypass", "caller_bypass", ["whole_request_fallback"] * 2, []),
    ("no bypass", body(U, OLD), json.dumps({"bypass": None, **json.loads(notes(i1=YES))}), {AT.format(1): 1.0}, "scored", "shadow_only", ["protected_structure", "high_irrelevance_score"], [1]),
    ("unknown", body(U, OLD), notes(i9=YES), {}, "bypass", "unknown_segment_reference", ["whole_request_fallback"] * 2, []),
    ("needs unknown", body(U, OLD), notes(i1={"depends_on": ["/x"]}), {}, "bypass", "unresolved_dependency", ["whole_request_fallback"] * 2, []),
    ("needs kind", body(U, OLD), notes(i1={"depends_on": [3]}), {}, "bypass", "unresolved_dependency", ["whole_request_fallback"] * 2, []),
    ("silent", body(OLD, A), notes(i0=YES), {AT.format(0): 1.0}, "bypass", "missing_user_intent", ["whole_request_fallback", "not_explicitly_eligible"], []),
    ("no scores", body(U, OLD), notes(i1=YES), {}, "bypass", "scorer_unavailable", ["protected_structure", "whole_request_fallback"], []),
    ("bad score", body(U, OLD, A), notes(i1=YES, i2=YES), {AT.format(1): 1.0, AT.format(2): float("nan")}, "bypass", "invalid_score_response", ["protected_structure", "whole_request_fallback", "whole_request_fallback"], []),
    ("broken body", body(U, OLD)[:-1], notes(i1=YES), {}, "bypass", "invalid_json", [], []),
    ("parts", body(U, NEW, OLD), json.dumps({"segments": {PART.format(1, 0): YES, PART.format(1, 1): YES}}), {PART.format(1, 0): 0.5, PART.format(1, 1): 1.0}, "scored", "shadow_only", ["protected_structure", "uncertain_score", "high_irrelevance_score", "not_explicitly_eligible"], ["1.1"]),
    ("all parts", body(NEW, U), json.dumps({"segments": {PART.format(0, 0): YES, PART.format(0, 1): YES}}), {PART.format(0, 0): 1.0, PART.format(0, 1): 1.0}, "scored", "shadow_only", ["high_irrelevance_score", "high_irrelevance_score", "protected_structure"], [0]),
    ("one batch fails", LONG, ALL, {AT.format(k): 1.0 if k != 40 else 7.0 for k in range(1, 71)}, "scored", "partial_batch_fallback", ["protected_structure"] + ["high_irrelevance_score"] * 32 + ["batch_fallback"] * 32 + ["high_irrelevance_score"] * 6, [*range(1, 33), *range(65, 71)]),
    ("all batches fail", LONG, ALL, {AT.format(k): 1.0 for k in (2, 3)}, "bypass", "all_batches_failed", ["protected_structure"] + ["whole_request_fallback"] * 70, []),
]


def test_active_gate(spark):
    df = spark.createDataFrame([(n, "openai_chat", b, p) for n, b, p, *_ in CASES] + [(k, "openai_chat", body(U, OLD), notes(i1=YES)) for k in ("twice", "twice", None)], "name string, wire string, raw string, side string")
    scores = spark.createDataFrame([(n, at, p) for n, _, _, s, *_ in CASES for at, p in s.items()], "name string, pointer string, p double")
    out = gate.active_gate(df, scores, "name", "raw", "wire", "side")
    back = removal.restored_bytes(F.col("forwarded"), F.col("held"), F.struct("receipt.bytes", "receipt.sha256", "receipt.reduced_bytes", "receipt.reduced_sha256", "receipt.cuts"))
    rows = out.withColumn("back", back).collect()
    assert sorted((str(r["name"]), r["reason"], bytes(r["forwarded"]).decode()) for r in rows if r["reason"] == "ambiguous_key") == sorted((k, "ambiguous_key", body(U, OLD)) for k in ("twice", "twice", "None"))
    got = {r["name"]: r for r in rows if r["reason"] != "ambiguous_key"}
    assert len(got) == len(CASES)
    for name, raw, _, _, status, reason, reasons, cut in CASES:
        r = got[name]
        assert (name, r["status"], r["reason"], [s["reason"] for s in r["receipt"]["segments"]]) == (name, status, reason, reasons)
        assert r["applied"] == bool(cut) and bytes(r["back"]["body"]) == raw.encode() and r["receipt"]["sha256"] == hashlib.sha256(raw.encode()).hexdigest()
        if not cut:
            assert bytes(r["forwarded"]).decode() == raw
            continue
        want = json.loads(raw)
        for i, m in enumerate(want["messages"]):
            if isinstance(m["content"], list):
                m["content"] = [x for j, x in enumerate(m["content"]) if f"{i}.{j}" not in cut]
        want["messages"] = [m for i, m in enumerate(want["messages"]) if i not in cut]
        assert json.loads(r["forwarded"]) == want
        assert [s["applied"] for s in r["receipt"]["segments"]] == [s == "high_irrelevance_score" for s in reasons]
