"""Request bodies as segments: three wire formats, reasons to pass a request by, score contracts and a shadow gate.

Nothing here changes a request; a gate proposes what could be dropped, and on any doubt proposes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.joins import closure
from decisa.operators.json_values import truthy, unquoted, values
from decisa.session import materialize

# Fixed values of the wire formats and the limits of a request.
FORMATS = ("openai_chat", "openai_responses", "anthropic_messages")
MOST_BYTES, MOST_SEGMENTS = 128_000, 128
PROTECTED_ROLES = ("system", "developer", "user", "tool", "control")
CONTROL_FIELDS = ("system", "instructions", "tools", "tool_choice", "response_format", "text", "metadata")
KNOWN_FIELDS = (
    "model", "messages", "input", "system", "instructions", "tools", "tool_choice", "response_format", "text", "metadata", "temperature", "top_p", "top_k",
    "max_tokens", "max_completion_tokens", "max_output_tokens", "stream", "stream_options", "stop", "stop_sequences", "seed", "n", "frequency_penalty",
    "presence_penalty", "user", "safety_identifier", "service_tier", "store", "reasoning", "thinking", "parallel_tool_calls", "truncation",
    "previous_response_id", "conversation", "prompt",
)
SERVER_FIELDS = ("previous_response_id", "conversation", "prompt")
MESSAGE_FIELDS = ("role", "content", "name", "tool_calls", "function_call", "tool_call_id", "type", "id", "status")
TOOL_FIELDS = ("tool_calls", "function_call", "tool_call_id", "name")
PART_FIELDS = ("type", "text", "citations", "annotations", "cache_control")
TEXT_PARTS, TOOL_PARTS = ("text", "input_text", "output_text"), ("tool_use", "tool_result")

SEGMENT = "array<struct<pointer: string, role: string, text: string, protected: boolean, start: bigint, stop: bigint>>"


def _pick(test: Column, what: Column) -> Column:
    """The value of a group's only row that passes a test."""
    return F.max(F.when(test, what))


def _any(test: Column) -> Column:
    return F.coalesce(F.max(test), F.lit(False))


def _segment(pointer: Column, role: Column, text: Column, protected: Column, span: Column) -> Column:
    fields = [pointer.alias("pointer"), role.alias("role"), text.alias("text"), (protected | role.isin(*PROTECTED_ROLES)).alias("protected")]
    return F.struct(*fields, span["start"].alias("start"), span["stop"].alias("stop"))


def _some(test: Column, segment: Column) -> Column:
    """A segment as an array of one where a test holds, else an empty one."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(segment)).otherwise(_none())


def _none() -> Column:
    return F.array().cast(SEGMENT)


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _control(at: Column, span: Column, test: Column | None = None) -> Column:
    """A control segment, if its value is there."""
    return _some(span.isNotNull() if test is None else test, _segment(at, F.lit("control"), _nothing(), F.lit(True), span))


def _parts(v: DataFrame, ids: list[str]) -> DataFrame:
    """A row a message and part (j; null for the message's other values): what is needed of each."""
    p, lv, kind, string = (lambda k: F.get("path", F.lit(k - 1))), F.col("lv"), F.col("kind"), F.col("kind") == "string"
    span = F.struct("start", "stop")
    content = p(3) == "content"
    own = lambda name: content & (lv == 5) & (p(5) == name)
    field = lambda name: (lv == 3) & (p(3) == name)
    true = truthy(kind, F.col("token"), F.col("empty"))
    block = content & (p(5) == "content")
    part = {
        "p_kind": _pick(content & (lv == 4), kind), "p_span": _pick(content & (lv == 4), span),
        "p_type": _pick(own("type") & string, unquoted(F.col("token"))), "p_text": _pick(own("text") & string, unquoted(F.col("token"))), "p_text_span": _pick(own("text") & string, span),
        "p_fields": _any(content & (lv == 5) & ~p(5).isin(*PART_FIELDS)), "p_pinned": _any((own("citations") | own("annotations")) & true),
        "p_citations": _pick(own("citations"), span), "p_annotations": _pick(own("annotations"), span),
        "p_id": _pick(own("id") & string, unquoted(F.col("token"))), "p_use_id": _pick(own("tool_use_id") & string, unquoted(F.col("token"))),
        "p_content": _pick(own("content"), kind), "p_blocks": F.count_if(block & (lv == 6)),
        "p_fine": F.least(F.count_if(block & (lv == 6) & (kind == "object")), F.count_if(block & (lv == 7) & (p(7) == "type") & string & (unquoted(F.col("token")) == "text")), F.count_if(block & (lv == 7) & (p(7) == "text") & string)),
    }
    message = {
        "m_kind": _pick(lv == 2, kind), "m_span": _pick(lv == 2, span), "m_fields": _any((lv == 3) & ~p(3).isin(*MESSAGE_FIELDS)),
        "m_role": _pick(field("role") & string, unquoted(F.col("token"))), "m_item": _any(field("type") & ~(string & F.coalesce(unquoted(F.col("token")) == "message", F.lit(False)))),
        "m_content": _pick(field("content"), kind), "m_text": _pick(field("content") & string, unquoted(F.col("token"))), "m_text_span": _pick(field("content"), span), "m_empty": _any(field("content") & F.col("empty")),
        "m_calls": _pick(field("tool_calls"), kind), "m_calling": _any(field("tool_calls") & true), "m_legacy": _any(field("function_call") & true), "m_answering": _any(field("tool_call_id") & true),
        "m_call_id": _pick(field("tool_call_id") & string, unquoted(F.col("token"))), "m_n_calls": F.count_if((lv == 4) & (p(3) == "tool_calls")),
        "m_call_ids": F.sort_array(F.collect_list(F.when((lv == 5) & (p(3) == "tool_calls") & (p(5) == "id") & string, F.struct(p(4).try_cast("int").alias("k"), unquoted(F.col("token")).alias("id"))))),
        **{f"m_{f}": _pick(field(f), span) for f in TOOL_FIELDS},
    }
    body = {
        "b_kind": _pick(lv == 0, kind), "b_keys": F.collect_set(F.when(lv == 1, p(1))), "b_server": _any((lv == 1) & p(1).isin(*SERVER_FIELDS) & true),
        "b_list": _pick((lv == 1) & (p(1) == F.col("_name")), kind), "b_none": _any((lv == 1) & (p(1) == F.col("_name")) & F.col("empty")), "b_input": _pick((lv == 1) & (p(1) == F.col("_name")) & string, unquoted(F.col("token"))),
        "b_input_span": _pick((lv == 1) & (p(1) == F.col("_name")), span),
        **{f"b_{f}": _pick((lv == 1) & (p(1) == f), span) for f in CONTROL_FIELDS},
    }
    at = v.withColumn("i", F.when((lv >= 2) & (p(1) == F.col("_name")), p(2).try_cast("int"))).withColumn("j", F.when((lv >= 4) & content & F.col("i").isNotNull(), p(4).try_cast("int")))
    return at.groupBy(*ids, "i", "j").agg(*[c.alias(n) for n, c in (part | message | body).items()])


def _part_reason() -> Column:
    type_ = F.col("p_type")
    result = (F.coalesce("p_content", F.lit("string")) == "string") | ((F.col("p_content") == "array") & (F.col("p_fine") == F.col("p_blocks")))
    return (
        F.when(F.coalesce(F.col("p_kind") != "object", F.lit(True)), "unsupported_content").when(type_ == "tool_use", _nothing())
        .when(type_ == "tool_result", F.when(~result, "unsupported_content")).when(type_.isin(*TEXT_PARTS) & F.col("p_text").isNotNull(), F.when(F.col("p_fields"), "unsupported_content_fields"))
        .otherwise("unsupported_content")
    )


def _messages(parts: DataFrame, ids: list[str], format_: Column) -> DataFrame:
    """A row a message (i; null for what is outside of messages): its segments, its reasons, its calls and results."""
    firsts = [c for c in parts.columns if c[:2] in ("m_", "b_")]
    of_row = F.col("j").isNull()
    tool = F.col("p_type").isin(*TOOL_PARTS)
    part = F.struct("j", *[c for c in parts.columns if c[:2] == "p_"], _part_reason().alias("reason"))
    m = parts.groupBy(*ids, "i").agg(*[F.first(F.when(of_row, F.col(c)), True).alias(c) for c in firsts], F.sort_array(F.collect_list(F.when(~of_row, part))).alias("parts"), _any(~of_row & tool).alias("m_tool"))
    chat, anthropic, role = format_ == "openai_chat", format_ == "anthropic_messages", F.coalesce("m_role", F.lit(""))
    linked = F.col("m_calling") | F.col("m_legacy") | F.col("m_answering") | F.col("m_tool")
    pointer = F.concat(F.lit("/"), F.col("_name"), F.lit("/"), F.col("i"))

    def of_part(x: Column) -> Column:
        text = x["p_type"].isin(*TEXT_PARTS) & x["p_text"].isNotNull()
        at = F.concat(pointer, F.lit("/content/"), x["j"])
        notes = [_control(F.concat(at, F.lit(f"/{f}")), x[f"p_{f}"], text & x[f"p_{f}"].isNotNull()) for f in ("citations", "annotations")]
        own = _some(text, _segment(F.concat(at, F.lit("/text")), role, x["p_text"], linked | x["p_pinned"], x["p_text_span"]))
        return F.concat(_control(at, x["p_span"], x["p_type"].isin(*TOOL_PARTS)), own, *notes)

    fields = [_control(F.concat(pointer, F.lit(f"/{f}")), F.col(f"m_{f}")) for f in TOOL_FIELDS]
    own = _some(F.col("m_content") == "string", _segment(F.concat(pointer, F.lit("/content")), role, F.col("m_text"), linked, F.col("m_text_span")))
    segments = F.concat(*fields, own, F.when(F.col("m_content") == "array", F.flatten(F.transform("parts", of_part))).otherwise(_none()))
    no_content = F.coalesce(F.col("m_content"), F.lit("null")) == "null"
    first_part = F.get(F.filter("parts", lambda x: x["reason"].isNotNull()), F.lit(0))["reason"]
    roles = F.when(anthropic, role.isin("user", "assistant")).otherwise(role.isin("system", "developer", "user", "assistant", "tool"))
    reason = (
        F.when(F.col("m_fields"), "unsupported_message_fields").when((format_ == "openai_responses") & F.col("m_item"), "unsupported_response_item").when(~roles, "unsupported_role")
        .when(no_content, F.when(~linked, "unsupported_content")).when(F.col("m_content") == "string", _nothing()).when((F.col("m_content") == "array") & ~F.col("m_empty"), first_part).otherwise("unsupported_content")
    )
    called = F.when(chat, F.transform("m_call_ids", lambda x: x["id"])).when(anthropic, F.transform(F.filter("parts", lambda x: x["p_type"] == "tool_use"), lambda x: x["p_id"])).otherwise(F.array().cast("array<string>"))
    answered = (
        F.when(chat & (role == "tool"), F.array("m_call_id")).when(anthropic, F.transform(F.filter("parts", lambda x: x["p_type"] == "tool_result"), lambda x: x["p_use_id"])).otherwise(F.array().cast("array<string>"))
    )
    has = lambda type_: F.exists("parts", lambda x: F.coalesce(x["p_type"] == type_, F.lit(False)))
    in_chat = chat & F.col("m_calls").isNotNull() & ((F.col("m_calls") != "array") | ((F.col("m_n_calls") > 0) & (role != "assistant")) | (F.size("m_call_ids") != F.col("m_n_calls")))
    in_parts = anthropic & (F.col("m_content") == "array") & ((has("tool_use") & (role != "assistant")) | (has("tool_result") & (role != "user")))
    fault = (
        F.when(F.coalesce(F.col("m_kind") != "object", F.lit(True)), F.lit(0)).when(F.col("m_legacy"), F.lit(1)).when(F.coalesce(in_chat | in_parts, F.lit(False)), F.lit(2))
    )
    removable = F.struct(F.col("i"), F.col("m_span").alias("span"), F.when(F.col("m_content") == "array", F.transform("parts", lambda x: x["p_span"])).alias("parts"))
    return m.select(*ids, "i", *[c for c in m.columns if c[:2] == "b_"], segments.alias("segments"), reason.alias("reason"), fault.alias("fault"), called.alias("called"), answered.alias("answered"), removable.alias("spans"))


def parsed_requests(df: DataFrame, key: str, raw: str, format_: str) -> DataFrame:
    """(key, reason, segments, spans): each request body as segments (pointer, role, text, protected, start, stop), or why
    it is passed by: unsupported_format, request_budget_exceeded, invalid_json, invalid_envelope,
    unsupported_envelope_fields, unresolved_server_context, invalid_messages; then of the first message with a fault
    invalid_message, unsupported_legacy_tool_call or unresolved_tool_link; then of the first message with one
    unsupported_message_fields, unsupported_response_item, unsupported_role, unsupported_content or
    unsupported_content_fields; or segment_budget_exceeded.

    start and stop are the bytes of a segment's value in the body; spans has the bytes of each message and of its content
    parts. Passed by requests have neither. A body's JSON values become rows once, and reasons and segments are
    aggregates of them: one shuffle, by body. Rows of equal or null keys stand for themselves."""
    rows = df.select(F.col(key), F.col(format_).alias("_format"), F.col(raw).cast("string").alias("_body"))
    size = F.octet_length("_body")
    rows = rows.select(key, "_format", size.alias("_bytes"), F.when(F.coalesce(F.col("_format").isin(*FORMATS) & (size <= MOST_BYTES), F.lit(False)), F.col("_body")).alias("_body"))
    rows = rows.withColumn("_name", F.when(F.col("_format") == "openai_responses", "input").otherwise("messages"))
    ids = ["_row", key, "_format", "_bytes", "_name", "_valid"]
    m = _messages(_parts(values(rows, "_body"), ids), ids, F.col("_format"))
    facts = [c for c in m.columns if c[:2] == "b_"]
    outside = F.col("i").isNull()
    message = F.struct("i", "reason", "fault", "segments", "called", "answered", "spans")
    g = m.groupBy(*ids).agg(*[F.first(F.when(outside, F.col(c)), True).alias(c) for c in facts], F.sort_array(F.collect_list(F.when(~outside, message))).alias("m"))
    numbered = lambda name: F.flatten(F.transform("m", lambda x: F.transform(x[name], lambda id_: F.struct(x["i"].alias("i"), id_.alias("id")))))
    g = g.withColumns({"_called": numbered("called"), "_answered": numbered("answered")})
    nameless = lambda x: F.coalesce(x["id"] == "", F.lit(True))
    again = lambda of, x, k: F.exists(F.slice(of, F.lit(1), k), lambda y: y["id"] == x["id"])
    wrong_call = F.filter("_called", lambda x, k: nameless(x) | again("_called", x, k))
    wrong_answer = F.filter("_answered", lambda x, k: nameless(x) | again("_answered", x, k) | ~F.exists("_called", lambda y: (y["id"] == x["id"]) & (y["i"] <= x["i"])))
    at = lambda x, code: F.struct(x["i"].alias("i"), F.lit(code).alias("code"))
    faults = F.concat(F.transform(F.filter("m", lambda x: x["fault"].isNotNull()), lambda x: F.struct(x["i"].alias("i"), x["fault"].alias("code"))), F.transform(wrong_call, lambda x: at(x, 2)), F.transform(wrong_answer, lambda x: at(x, 2)))
    pending = F.size("_called") > F.size("_answered")
    fault = F.coalesce(F.array_min(faults)["code"], F.when(pending, F.lit(2)))
    first = F.get(F.filter("m", lambda x: x["reason"].isNotNull()), F.lit(0))["reason"]
    format_col, single = F.col("_format"), (F.col("_format") == "openai_responses") & (F.coalesce(F.col("b_list"), F.lit("")) == "string")
    controls = [_control(F.lit(f"/{f}"), F.col(f"b_{f}")) for f in CONTROL_FIELDS]
    only = _some(single, _segment(F.lit("/input"), F.lit("user"), F.col("b_input"), F.lit(False), F.col("b_input_span")))
    g = g.withColumn("_s", F.concat(*controls, only, F.when(single, _none()).otherwise(F.flatten(F.transform("m", lambda x: x["segments"])))))
    structured = F.when(fault == 0, "invalid_message").when(fault == 1, "unsupported_legacy_tool_call").when(fault == 2, "unresolved_tool_link").otherwise(first)
    reason = (
        F.when(~F.coalesce(format_col.isin(*FORMATS), F.lit(False)), "unsupported_format")
        .when(F.col("_bytes") > MOST_BYTES, "request_budget_exceeded")
        .when(~F.col("_valid"), "invalid_json")
        .when(F.col("b_kind") != "object", "invalid_envelope")
        .when(F.size(F.array_except("b_keys", F.array(*map(F.lit, KNOWN_FIELDS)))) > 0, "unsupported_envelope_fields")
        .when(F.col("b_server"), "unresolved_server_context")
        .when(~single & (F.coalesce(F.col("b_list") != "array", F.lit(True)) | F.col("b_none")), "invalid_messages")
        .when(~single & structured.isNotNull(), structured)
        .when(F.size("_s") > MOST_SEGMENTS, "segment_budget_exceeded")
    )
    g = g.withColumn("reason", reason)
    spans = F.transform("m", lambda x: x["spans"])
    passed = F.col("reason").isNull()
    return g.select(key, "reason", F.when(passed, F.col("_s")).otherwise(_none()).alias("segments"), F.when(passed & ~single, spans).otherwise(F.slice(spans, F.lit(1), F.lit(0))).alias("spans"))


def wire_segments(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, pointer, role, text, protected): a row a segment of the parsed requests."""
    return parsed.select(key, F.posexplode("segments").alias("pos", "s")).select(key, "pos", "s.*")


def score_reason(expected: Column, answers: Column, tolerance: float = 1e-6) -> Column:
    """Why a scorer's answer is not taken, else null: answers is a map of candidate id -> map of label -> probability.

    wrong_ids unless it has exactly the expected ids; wrong_labels unless each is over exactly false and true; not_finite
    and out_of_range for a probability that is null, NaN, infinite or outside [0, 1]; wrong_sum when two don't add up to
    1. A null answer has the wrong ids."""
    values = F.map_values(answers)
    fine = lambda test: F.forall(values, lambda v: F.coalesce(test(v), F.lit(False)))
    p = lambda v: F.map_values(v)
    return (
        F.when(~F.coalesce(F.array_sort(F.map_keys(answers)) == F.array_sort(expected), F.lit(False)), "wrong_ids")
        .when(~fine(lambda v: F.array_sort(F.map_keys(v)) == F.array(F.lit("false"), F.lit("true"))), "wrong_labels")
        .when(~fine(lambda v: F.forall(p(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), "not_finite")
        .when(~fine(lambda v: F.forall(p(v), lambda x: (x >= 0) & (x <= 1))), "out_of_range")
        .when(~fine(lambda v: F.abs(v["false"] + v["true"] - 1) <= tolerance), "wrong_sum")
    )


def shadow_gate(parsed: DataFrame, scores: DataFrame, depends: DataFrame, key: str, threshold: float = 0.99) -> DataFrame:
    """(key, pos, pointer, suggestion, reason): what a gate would drop, never dropped here.

    parsed: parsed_requests(); scores: (key, pointer, p) of irrelevance; depends: (key, pointer, needs) between
    pointers of one request. A passed by request has no rows. In one without a user's text every segment stays
    (missing_user_intent). A protected segment stays (protected), so does one without a score in [0, 1]
    (invalid_score), with one of at most 1 - threshold (model_retain) or under the threshold (uncertain_score), and all
    that a staying segment needs, at any distance (dependency)."""
    s = materialize(wire_segments(parsed, key), "segments")
    intent = F.max(((F.col("role") == "user") & F.col("text").isNotNull()).cast("int")).over(Window.partitionBy(key))
    s = s.withColumn("_intent", intent == 1).join(scores.groupBy(key, "pointer").agg(F.max("p").alias("p"), F.count("*").alias("_n")), [key, "pointer"], "left")
    valid = F.coalesce((F.col("_n") == 1) & (F.col("p") >= 0) & (F.col("p") <= 1), F.lit(False))
    own = (
        F.when(~F.col("_intent"), "missing_user_intent").when(F.coalesce(F.col("protected"), F.lit(True)) | F.col("text").isNull(), "protected")
        .when(~valid, "invalid_score").when(F.col("p") <= 1 - threshold, "model_retain").when(F.col("p") < threshold, "uncertain_score")
    )
    s = s.withColumn("reason", own)
    stays = s.filter("reason is not null").select(F.col(key).alias("group"), F.col("pointer").alias("node"))
    edges = depends.select(F.col(key).alias("group"), F.col("pointer").alias("src"), F.col("needs").alias("dst"))
    needed = closure(edges, stays).select(F.col("group").alias(key), F.col("node").alias("pointer"), F.lit(True).alias("_needed"))
    s = s.join(needed, [key, "pointer"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_needed"), "dependency"), F.lit("high_irrelevance_score")))
    return s.select(key, "pos", "pointer", F.when(F.col("reason") == "high_irrelevance_score", "drop").otherwise("retain").alias("suggestion"), "reason")
