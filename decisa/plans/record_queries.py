"""Queries on records: canonical JSON, request bodies in three formats, transcripts, gates, splits and books by day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from decisa.functions import jsons, text, windows
from decisa.operators import panel as books
from decisa.operators import gate, ranks, removal, requests, resample, transcripts
from decisa.plans.base import PANEL, SCORED, panel, query, rounded, scored, table
from decisa.session import fresh_path
from decisa.sources import readers, sinks

W = "PARTITION BY asset ORDER BY day"


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.withColumn("i", place)


TURNS = "turns AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"


@query("""WITH n AS (SELECT *, CASE turn % 7 WHEN 0 THEN '100.0' WHEN 1 THEN '100' WHEN 2 THEN '-0.0' WHEN 3 THEN '1e-07' WHEN 4 THEN repeat('1234567890', 5) WHEN 5 THEN '1.5' ELSE '1e+16' END AS n FROM conversations)
SELECT conv_id, turn, sha256('{"n":' || n || ',"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || ',"' || chr(65518) || '":1,"' || chr(128512) || '":2}') AS identity FROM n""")
def canonical_identity(spark, sf_dir):
    """A turn's identity is the hash of its canonical JSON, whatever the order of its fields and the spaces; numbers of
    all spellings keep their value and kind, and keys are in the order of code points."""
    t, spelt = table(spark, sf_dir, "conversations"), F.array(*map(F.lit, ("100.0", "100", "-0.0", "1E-7", "1234567890" * 5, "1.50", "1E16")))
    said = F.to_json(F.struct("turn", "text", "role"))
    raw = F.concat(F.lit('{ "\U0001f600" : 2 ,\n"\uffee":1, "n":'), F.get(spelt, (F.col("turn") % 7).cast("int")), F.lit(" , "), F.substring(said, F.lit(2), F.length(said)))
    return t.select("conv_id", "turn", jsons.identity(raw).alias("identity"))


@query("""WITH d AS (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY lang, source, text ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM d WHERE k = 1""")
def canonical_dedup(spark, sf_dir):
    """One record of each canonical request, the first seen; the order of its fields differs from row to row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    one, other = F.to_json(F.struct("text", "lang", "source"), {"ignoreNullFields": "false"}), F.to_json(F.struct("source", "text", "lang"), {"ignoreNullFields": "false"})
    d = d.select("doc_id", jsons.identity(F.when(F.col("doc_id") % 2 == 0, one).otherwise(other)).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""SELECT event_id, event_type = 'error' OR json_exists(props, '$.k') AND event_type = 'view' AS forbidden, CAST(3 + len(json_keys(props)) AS INT) AS keys FROM events""")
def forbidden_key_walk(spark, sf_dir):
    """Events as nested JSON in which a key hides at the third level; the walk looks at every level."""
    e = table(spark, sf_dir, "events")
    inner = F.concat(F.lit('{"m":[{"'), F.when(F.col("event_type") == "error", "secret").when(F.col("event_type") == "view", "look").otherwise("x"), F.lit('":'), F.col("props"), F.lit('}],"v":"secret\\":"}'))
    names = F.when(F.col("event_type") == "view", jsons.has_any_key(inner, ["k"])).otherwise(jsons.has_any_key(inner, ["secret"]))
    return e.select("event_id", names.alias("forbidden"), F.size(jsons.keys(inner)).alias("keys"))


def _bodies(spark, sf_dir):
    """A request body of each conversation; conv_id names its format: chat, responses, message parts."""
    t = _turns(spark, sf_dir)
    wire = F.element_at(F.array(*map(F.lit, requests.FORMATS)), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    m = F.struct(F.col("i"), F.col("role"), F.col("text").alias("content"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("m")).withColumn("wire", wire)
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    parts = lambda kind: F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit(kind).alias("type"), x["content"].alias("text"))).alias("content")))
    body = (
        F.when(F.col("wire") == "openai_chat", F.to_json(F.struct(F.lit("x").alias("model"), plain.alias("messages"))))
        .when(F.col("wire") == "openai_responses", F.to_json(F.struct(parts("input_text").alias("input"), F.lit("short").alias("instructions"))))
        .otherwise(F.to_json(F.struct(parts("text").alias("messages"), F.lit(10).alias("max_tokens"))))
    )
    return g.select("conv_id", "wire", body.alias("raw"))


@query(f"""WITH {TURNS}, g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS s FROM turns GROUP BY 1), ok AS (SELECT conv_id FROM g WHERE NOT (conv_id % 3 = 2 AND s > 0))
SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN 1 ELSE 0 END + i AS pos, CASE conv_id % 3 WHEN 0 THEN '/messages/' || i || '/content' WHEN 1 THEN '/input/' || i || '/content/0/text' ELSE '/messages/' || i || '/content/0/text' END AS pointer, role, md5(text) AS digest, role <> 'assistant' AS protected
FROM turns JOIN ok USING (conv_id) UNION ALL SELECT conv_id, 0, '/instructions', 'control', NULL, true FROM ok WHERE conv_id % 3 = 1""")
def wire_segments(spark, sf_dir):
    """Bodies of three wire formats parsed back to segments; a system message is no role of one of them."""
    s = requests.wire_segments(requests.parsed_requests(_bodies(spark, sf_dir), "conv_id", "raw", "wire"), "conv_id")
    return s.select("conv_id", F.col("pos").cast("long").alias("pos"), "pointer", "role", F.md5("text").alias("digest"), "protected")


@query(f"""WITH {TURNS}, g AS (SELECT conv_id, count(*) FILTER (role = 'system') AS s FROM turns GROUP BY 1)
SELECT conv_id, CASE conv_id % 8 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'unsupported_envelope_fields' WHEN 3 THEN 'request_budget_exceeded' WHEN 4 THEN 'unsupported_format' WHEN 5 THEN 'invalid_envelope' ELSE CASE WHEN conv_id % 3 = 2 AND s > 0 THEN 'unsupported_role' END END AS reason FROM g""")
def request_reasons(spark, sf_dir):
    """Why requests are passed by: faults written into the bodies by conversation, and roles that a format hasn't."""
    fault, raw = F.pmod("conv_id", F.lit(8)), F.col("raw")
    raw = F.when(fault == 1, F.concat(raw, F.lit("}"))).when(fault == 2, F.concat(F.lit('{"zzz":1,'), F.substring(raw, F.lit(2), F.length(raw)))).when(fault == 3, F.concat(raw, F.repeat(F.lit(" "), 128_001))).when(fault == 5, F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    b = _bodies(spark, sf_dir).select("conv_id", raw.alias("raw"), F.when(fault == 4, "other").otherwise(F.col("wire")).alias("wire"))
    return requests.parsed_requests(b, "conv_id", "raw", "wire").select("conv_id", "reason")


@query(f"""WITH {SCORED}, f AS (SELECT id, id % 6 AS f, p FROM scored)
SELECT id, CASE f WHEN 1 THEN 'wrong_ids' WHEN 2 THEN 'wrong_labels' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'out_of_range' WHEN 5 THEN 'wrong_sum' END AS reason FROM f""")
def score_contract(spark, sf_dir):
    """A scorer's answers against its contract; each kind of fault stands in some rows."""
    s, f = scored(spark, sf_dir).select("id", "p"), F.pmod("id", F.lit(6))
    p = F.when(f == 3, float("nan")).when(f == 4, -F.col("p")).otherwise(F.col("p"))
    two = F.create_map(F.lit("true"), p, F.lit("false"), 1 - p + F.when(f == 5, 0.001).otherwise(0.0))
    answer = F.when(f == 2, F.create_map(F.lit("true"), F.lit(1.0).cast("double"))).otherwise(two)
    answers = F.create_map(F.when(f == 1, "irrelevant_9").otherwise("irrelevant_0"), answer)
    return s.select("id", requests.score_reason(F.array(F.lit("irrelevant_0")), answers).alias("reason"))


SEG = f"""{TURNS}, ok AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u FROM turns GROUP BY 1 HAVING NOT (conv_id % 3 = 2 AND count(*) FILTER (role = 'system') > 0)),
seg AS (SELECT t.conv_id, CASE WHEN t.conv_id % 3 = 1 THEN 1 ELSE 0 END + i AS pos, i, role, text, u, CAST(('0x' || substring(md5(t.conv_id || ':' || i), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS p,
  CASE t.conv_id % 3 WHEN 0 THEN '/messages/' || i || '/content' WHEN 1 THEN '/input/' || i || '/content/0/text' ELSE '/messages/' || i || '/content/0/text' END AS pointer FROM turns t JOIN ok USING (conv_id))"""


def _scores(t):
    """Scores of turns as hashes, and the pointers of turns and of those three before, in the format of a conversation."""
    pointer = lambda i: F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("/messages/"), i, F.lit("/content"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("/input/"), i, F.lit("/content/0/text"))).otherwise(F.concat(F.lit("/messages/"), i, F.lit("/content/0/text")))
    p = F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "i").cast("binary")), 1, 8), 16, 10).cast("double") / float(16**8)
    return t.select("conv_id", "i", "role", pointer(F.col("i")).alias("pointer"), F.when(F.col("i") >= 3, pointer(F.col("i") - 3)).alias("needs"), p.alias("p"))


@query(f"""WITH {SEG},
o AS (SELECT *, CASE WHEN u = 0 THEN 'missing_user_intent' WHEN role <> 'assistant' THEN 'protected' WHEN p <= 0.4 THEN 'model_retain' WHEN p < 0.6 THEN 'uncertain_score' END AS own FROM seg),
n AS (SELECT conv_id, i FROM o x WHERE EXISTS (SELECT 1 FROM o y WHERE y.conv_id = x.conv_id AND y.own IS NOT NULL AND y.i > x.i AND (y.i - x.i) % 3 = 0))
SELECT o.conv_id, o.pos, CASE WHEN own IS NULL AND n.i IS NULL THEN 'drop' ELSE 'retain' END AS suggestion, coalesce(own, CASE WHEN n.i IS NOT NULL THEN 'dependency' END, 'high_irrelevance_score') AS reason FROM o LEFT JOIN n ON n.conv_id = o.conv_id AND n.i = o.i
UNION ALL SELECT conv_id, 0, 'retain', CASE WHEN u = 0 THEN 'missing_user_intent' ELSE 'protected' END FROM ok WHERE conv_id % 3 = 1""")
def shadow_gate(spark, sf_dir):
    """What a gate at 0.6 would drop of all bodies, scores being hashes; each turn needs the one three before it."""
    t = _scores(_turns(spark, sf_dir))
    parsed = requests.parsed_requests(_bodies(spark, sf_dir), "conv_id", "raw", "wire")
    out = requests.shadow_gate(parsed, t.select("conv_id", "pointer", "p"), t.filter("needs is not null").select("conv_id", "pointer", "needs"), "conv_id", 0.6)
    return out.select("conv_id", F.col("pos").cast("long").alias("pos"), "suggestion", "reason")


#: What the policies and scores of the active gate's query get wrong, by every third part of the conversation's number.
GATED = f"""{SEG}, f AS (SELECT *, (conv_id // 3) % 9 AS f FROM seg),
a AS (SELECT *, CASE WHEN role <> 'assistant' THEN 'protected_structure' WHEN f = 8 AND i % 4 = 1 THEN 'caller_protected' WHEN f = 5 OR f = 8 AND i % 4 = 3 THEN 'not_explicitly_eligible' END AS own FROM f),
b AS (SELECT *, coalesce(own, CASE WHEN f <> 5 AND EXISTS (SELECT 1 FROM a y WHERE y.conv_id = a.conv_id AND y.own IS NOT NULL AND y.i > a.i AND (y.i - a.i) % 3 = 0) THEN 'required_dependency' END) AS early FROM a),
r AS (SELECT conv_id, any_value(f) AS f, count(*) FILTER (early IS NULL) AS candidates, any_value(u) AS u, min(i) FILTER (early IS NULL) AS first FROM b GROUP BY 1),
q AS (SELECT conv_id, CASE WHEN f = 1 THEN 'invalid_sidecar' WHEN f = 2 THEN 'caller_bypass' WHEN f = 3 THEN 'unknown_segment_reference' WHEN f = 4 THEN 'unresolved_dependency' WHEN u = 0 THEN 'missing_user_intent' WHEN candidates = 0 THEN 'no_eligible_segments' WHEN f = 7 THEN 'scorer_unavailable' WHEN f = 6 THEN 'invalid_score_response' END AS stop FROM r),
c AS (SELECT b.*, stop, CASE WHEN stop IN ('invalid_sidecar', 'caller_bypass', 'unknown_segment_reference', 'unresolved_dependency') THEN 'whole_request_fallback' WHEN early IS NOT NULL THEN early WHEN stop IS NOT NULL THEN 'whole_request_fallback' WHEN p <= 0.4 THEN 'model_retain' WHEN p < 0.6 THEN 'uncertain_score' END AS late FROM b JOIN q USING (conv_id)),
g AS (SELECT *, coalesce(late, CASE WHEN f <> 5 AND EXISTS (SELECT 1 FROM c y WHERE y.conv_id = c.conv_id AND y.late IS NOT NULL AND y.i > c.i AND (y.i - c.i) % 3 = 0) THEN 'required_dependency' END, 'high_irrelevance_score') AS reason FROM c)"""


def _gated(spark, sf_dir):
    """The active gate over all conversations: policies and scores of which each kind of fault has a share."""
    t = _scores(_turns(spark, sf_dir)).withColumn("f", F.floor(F.col("conv_id") / 3) % 9)
    note = F.struct(F.lit(True).alias("eligible"), F.when(F.col("f") == 4, F.array(F.lit("/x"))).otherwise(F.when(F.col("needs").isNotNull(), F.array("needs"))).alias("depends_on"), F.when((F.col("f") == 8) & (F.col("i") % 4 == 1), F.lit(True)).alias("cited"))
    note = F.when((F.col("f") == 8) & (F.col("i") % 4 == 3), note.withField("eligible", F.lit(False))).otherwise(note)
    notes = F.map_from_entries(F.collect_list(F.struct(F.when(F.col("f") == 3, F.concat("pointer", F.lit("/x"))).otherwise(F.col("pointer")), note)))
    f = F.first("f")
    side = F.when(f == 1, "[]").when(f == 2, '{"bypass":true}').when(f == 5, F.lit(None).cast("string")).otherwise(F.to_json(F.struct(notes.alias("segments"))))
    bodies = _bodies(spark, sf_dir).join(t.groupBy("conv_id").agg(side.alias("side")), "conv_id")
    scores = t.filter("f <> 7").select("conv_id", "pointer", F.when(F.col("f") == 6, F.col("p") + 2).otherwise(F.col("p")).alias("p"))
    return gate.active_gate(bodies, scores, "conv_id", "raw", "wire", "side", 0.6)


@query(f"""WITH {GATED}, x AS (
  SELECT conv_id, any_value(stop) AS stop, count(*) FILTER (reason = 'high_irrelevance_score') AS gone,
    string_agg(CASE WHEN reason = 'high_irrelevance_score' THEN NULL WHEN conv_id % 3 = 0 THEN '{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}'
      ELSE '{{"role":' || to_json(role) || ',"content":[{{"type":"' || CASE WHEN conv_id % 3 = 1 THEN 'input_text' ELSE 'text' END || '","text":' || to_json(text) || '}}]}}' END, ',' ORDER BY i) AS m FROM g GROUP BY 1)
SELECT conv_id, CASE WHEN stop IS NULL THEN 'scored' ELSE 'bypass' END AS status, coalesce(stop, 'shadow_only') AS reason, gone > 0 AS applied,
  sha256(CASE conv_id % 3 WHEN 0 THEN '{{"model":"x","messages":[' || m || ']}}' WHEN 1 THEN '{{"input":[' || m || '],"instructions":"short"}}' ELSE '{{"messages":[' || m || '],"max_tokens":10}}' END) AS forwarded, CAST(gone AS BIGINT) AS segments, true AS restored FROM x
UNION ALL SELECT conv_id, 'bypass', 'unsupported_role', false, sha256('{{"messages":[' || string_agg('{{"role":' || to_json(role) || ',"content":[{{"type":"text","text":' || to_json(text) || '}}]}}', ',' ORDER BY i) || '],"max_tokens":10}}'), 0, true FROM turns WHERE conv_id NOT IN (SELECT conv_id FROM ok) GROUP BY 1""")
def active_gate(spark, sf_dir):
    """What the gate sends on, by bytes, of the bodies of all conversations, and whether the original comes back."""
    g = _gated(spark, sf_dir)
    back = removal.restored_bytes(F.col("forwarded"), F.col("held"), F.struct("receipt.bytes", "receipt.sha256", "receipt.reduced_bytes", "receipt.reduced_sha256", "receipt.cuts"))
    gone = F.size(F.filter("receipt.segments", lambda s: s["applied"]))
    g = g.withColumn("back", back)
    return g.select("conv_id", "status", "reason", "applied", F.sha2("forwarded", 256).alias("forwarded"), gone.cast("long").alias("segments"), (F.sha2("back.body", 256) == F.col("receipt.sha256")).alias("restored"))


@query(f"""WITH {GATED} SELECT conv_id, pointer, role, sha256(to_json(text)) AS digest, reason, reason = 'high_irrelevance_score' AS applied FROM g
UNION ALL SELECT conv_id, '/instructions', 'control', sha256('"short"'), CASE WHEN stop IN ('invalid_sidecar', 'caller_bypass', 'unknown_segment_reference', 'unresolved_dependency') THEN 'whole_request_fallback' ELSE 'protected_structure' END, false FROM q WHERE conv_id % 3 = 1""")
def gate_receipt(spark, sf_dir):
    """The receipt of the active gate: every segment's pointer, hash and reason, without content."""
    return _gated(spark, sf_dir).select("conv_id", F.inline("receipt.segments")).select("conv_id", "pointer", "role", F.col("sha256").alias("digest"), "reason", "applied")


SPACED = """SELECT conv_id, i, role, '{ "role" :' || chr(10) || to_json(role) || ', "content":[ {"type":"text" , "text":' || to_json(text) || '}]}' AS m, (i * 7 + conv_id) % 3 = 0 AS gone FROM turns"""


@query(f"""WITH {TURNS}, s AS ({SPACED}), g AS (SELECT conv_id, bool_and(gone) AS none, count(*) FILTER (gone) AS n,
  '[ ' || string_agg(m, ' ,' || chr(9) ORDER BY i) || ' ]' AS w, '[ ' || string_agg(m, ' ,' || chr(9) ORDER BY i) FILTER (NOT gone) || ' ]' AS k FROM s GROUP BY 1)
SELECT conv_id, sha256('{{"messages":' || w || ' , "model":"x" }}') AS original, sha256('{{"messages":' || k || ' , "model":"x" }}') AS reduced, CASE WHEN NOT none THEN octet_length(encode(w)) - octet_length(encode(k)) END AS cut_bytes,
  CASE WHEN NOT none THEN sha256('{{"messages":' || w || ' , "model":"x" }}') END AS restored, CASE WHEN none THEN 'damaged_reduced' WHEN n > 0 THEN 'damaged_segment' END AS fault FROM g""")
def byte_removal(spark, sf_dir):
    """Messages cut out of oddly spaced bodies by bytes and put back; a byte of the first held cut is then changed, which
    must be noticed. A body that would lose all its messages isn't cut."""
    t = _turns(spark, sf_dir)
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    m = F.concat(F.lit('{ "role" :\n'), quoted(F.col("role")), F.lit(', "content":[ {"type":"text" , "text":'), quoted(F.col("text")), F.lit("}]}"))
    gone = F.when((F.col("i") * 7 + F.col("conv_id")) % 3 == 0, F.concat(F.lit("/messages/"), "i", F.lit("/content/0/text")))
    g = t.select("conv_id", F.struct("i", m.alias("m")).alias("m"), gone.alias("gone")).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"), F.collect_list("gone").alias("gone"))
    b = g.select("conv_id", "gone", F.lit("openai_chat").alias("wire"), F.concat(F.lit('{"messages":[ '), F.array_join(F.transform("m", lambda x: x["m"]), " ,\t"), F.lit(' ] , "model":"x" }')).alias("raw"))
    parsed = requests.parsed_requests(b, "conv_id", "raw", "wire").select("conv_id", "spans")
    cut = parsed.join(b, "conv_id").withColumn("r", removal.removed_bytes(F.col("raw"), removal.request_cuts(F.col("spans"), F.col("gone"))))
    worse = F.transform("r.held", lambda h, k: F.when(k == 0, F.concat(F.substring(h, F.lit(1), F.octet_length(h) - 1), F.lit(b"?"))).otherwise(h))
    cut = cut.withColumns({"back": removal.restored_bytes(F.col("r.reduced"), F.col("r.held"), F.col("r.manifest")), "bad": removal.restored_bytes(F.col("r.reduced"), worse, F.col("r.manifest"))})
    return cut.select("conv_id", F.sha2("raw", 256).alias("original"), F.sha2("r.reduced", 256).alias("reduced"), (F.col("r.manifest.bytes") - F.col("r.manifest.reduced_bytes")).alias("cut_bytes"), F.sha2("back.body", 256).alias("restored"), F.col("bad.fault").alias("fault"))


def _sessions(spark, sf_dir):
    """Session events of each conversation, a JSON line a turn: users say texts, and even ones a tool result too;
    assistants say a text and call a tool on a file that follows from the turn; system turns are meta events."""
    t, null = _turns(spark, sf_dir), F.lit(None)
    path = F.concat(F.lit("./src/f"), F.pmod(F.length("text"), F.lit(3)), F.lit(".py"))
    use = F.struct(F.lit("tool_use").alias("type"), null.cast("string").alias("text"), F.when(F.col("i") % 4 == 3, "Edit").otherwise("Read").alias("name"), F.struct(path.alias("file_path")).alias("input"), null.cast("string").alias("content"))
    block = lambda kind, text_, content: F.struct(F.lit(kind).alias("type"), text_.alias("text"), null.cast("string").alias("name"), null.cast("struct<file_path: string>").alias("input"), content.alias("content"))
    said = F.array(block("text", F.col("text"), null.cast("string")), use)
    result = F.array(block("tool_result", null.cast("string"), F.concat(F.lit("out "), F.col("i"))), block("text", F.col("text"), null.cast("string")))
    of = lambda type_, content, meta: F.to_json(F.struct(F.lit(type_).alias("type"), F.struct(content.alias("content")).alias("message"), F.lit(meta).alias("isMeta")))
    line = F.when(F.col("role") == "assistant", of("assistant", said, False)).when(F.col("role") == "system", of("user", F.col("text"), True)).when(F.col("i") % 2 == 0, of("user", result, False)).otherwise(of("user", F.col("text"), False))
    return t.select("conv_id", "i", line.alias("line"))


@query(f"""WITH {TURNS}, b AS (
  SELECT conv_id, i, 0 AS k, 'tool' AS role, 'tool_result' AS kind, 'out ' || i AS text FROM turns WHERE role NOT IN ('assistant', 'system') AND i % 2 = 0
  UNION ALL SELECT conv_id, i, 1, 'user', 'user_turn', text FROM turns WHERE role NOT IN ('assistant', 'system') AND regexp_matches(text, '\\S')
  UNION ALL SELECT conv_id, i, 0, 'assistant', 'assistant_text', text FROM turns WHERE role = 'assistant' AND regexp_matches(text, '\\S')
  UNION ALL SELECT conv_id, i, 1, 'assistant', 'tool_use', '{{"tool_use":{{"input":{{"file_path":"./src/f' || length(text) % 3 || '.py"}},"name":"' || CASE WHEN i % 4 = 3 THEN 'Edit' ELSE 'Read' END || '"}}}}' FROM turns WHERE role = 'assistant')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i, k) - 1 AS place, role, kind, md5(text) AS digest FROM b""")
def transcript_segments(spark, sf_dir):
    s = transcripts.transcript_segments(_sessions(spark, sf_dir), "conv_id", "i", "line")
    return s.select("conv_id", F.col("place").cast("long").alias("place"), "role", "kind", F.md5("text").alias("digest"))


@query(f"""WITH {TURNS} SELECT conv_id, i, CASE WHEN i % 4 = 3 THEN 'edit' ELSE 'read' END AS op, 'src/f' || length(text) % 3 || '.py' AS path FROM turns WHERE role = 'assistant'
UNION ALL SELECT conv_id, i, 'read', 'a/' || i FROM turns WHERE role = 'user' UNION ALL SELECT conv_id, i, 'list', 'a/' || i FROM turns WHERE role = 'user'""")
def tool_operations(spark, sf_dir):
    """Read and edit calls with path fields, and command lines that read and list."""
    t = _turns(spark, sf_dir)
    fields = F.to_json(F.struct(F.struct(F.when(F.col("i") % 4 == 3, "Edit").otherwise("Read").alias("name"), F.struct(F.concat(F.lit("./src/f"), F.pmod(F.length("text"), F.lit(3)), F.lit(".py")).alias("file_path")).alias("input")).alias("tool_use")))
    shell = F.to_json(F.struct(F.struct(F.lit("bash").alias("name"), F.concat(F.lit("cat ./a/"), F.col("i"), F.lit(" | head; ls")).alias("input")).alias("tool_use")))
    call = F.when(F.col("role") == "assistant", fields).when(F.col("role") == "user", shell)
    return t.select("conv_id", "i", F.inline(transcripts.tool_ops(call))).select("conv_id", F.col("i").cast("long").alias("i"), "op", F.explode("paths").alias("path"))


def _items(spark, sf_dir):
    """Response items of each conversation, a JSON line a turn: users speak beside a harness's part, assistants call and
    get their text as an output, system turns are instructions."""
    t, null = _turns(spark, sf_dir), F.lit(None).cast("string")
    part = lambda kind, words: F.struct(F.lit(kind).alias("type"), words.alias("text"))
    of = lambda **fields: F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]).alias("payload")))
    asked = of(type="message", role="user", content=F.array(part("input_text", F.lit("<environment_context>here")), part("input_text", F.col("text")), part("input_text", F.concat(F.lit("turn "), "i"))))
    told = F.when(F.col("i") % 4 == 1, of(type="function_call_output", output=F.col("text"))).when(F.col("i") % 4 == 3, of(type="function_call", name="shell", arguments=F.col("text"))).otherwise(of(type="message", role="assistant", content=F.array(part("output_text", F.col("text")))))
    line = F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", told).otherwise(of(type="message", role="developer", content=F.array(part("input_text", F.col("text")))))
    return t.select("conv_id", "i", line.alias("line"))


ITEMS = f"""{TURNS}, b AS (SELECT conv_id, i, CASE WHEN role = 'user' THEN 'user_turn' WHEN i % 4 = 1 THEN 'tool_result' WHEN i % 4 = 3 THEN 'tool_use' ELSE 'assistant_text' END AS kind,
  CASE WHEN role = 'user' THEN text || chr(10) || chr(10) || 'turn ' || i WHEN i % 4 = 3 THEN '{{"tool_use":{{"input":' || to_json(text) || ',"name":"shell"}}}}' ELSE text END AS text FROM turns WHERE role <> 'system'),
f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS place, kind, text, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM b)"""


@query(f"""WITH {ITEMS}, g AS (SELECT conv_id, count(*) AS n, max(upto) AS bytes FROM f GROUP BY 1) SELECT conv_id, place, kind, md5(text) AS digest FROM f JOIN g USING (conv_id) WHERE n <= 6 AND bytes <= 3000""")
def response_segments(spark, sf_dir):
    """Sessions in the grammar of response items, without those of more than six segments or 3,000 bytes."""
    s = transcripts.transcript_segments(_items(spark, sf_dir), "conv_id", "i", "line", most=6, most_bytes=3000, grammar="responses")
    return s.select("conv_id", F.col("place").cast("long").alias("place"), "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {ITEMS}, o AS (SELECT conv_id, place, CASE WHEN place >= 6 THEN 'segment_count_hard_cap' WHEN upto > 3000 THEN 'extracted_text_over_cap' END AS reason FROM f)
SELECT conv_id, arg_min(reason, place) AS reason, min(place) AS place FROM o WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT DISTINCT conv_id, 'no_segments', NULL FROM turns WHERE conv_id NOT IN (SELECT conv_id FROM f)""")
def dropped_transcripts(spark, sf_dir):
    """Why sessions of response items are left out."""
    d = transcripts.dropped_transcripts(_items(spark, sf_dir), "conv_id", "i", "line", most=6, most_bytes=3000, grammar="responses")
    return d.select("conv_id", "reason", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TURNS}, o AS (SELECT conv_id, i, 'src/f' || length(text) % 3 || '.py' AS path, i % 4 = 3 AS edit FROM turns WHERE role = 'assistant'),
n AS (SELECT a.conv_id, a.i, a.path, min(b.i) FILTER (b.edit) AS e, min(b.i) FILTER (NOT b.edit) AS r FROM o a LEFT JOIN o b ON a.conv_id = b.conv_id AND a.path = b.path AND b.i > a.i WHERE NOT a.edit GROUP BY 1, 2, 3)
SELECT conv_id, path, CASE WHEN e IS NOT NULL THEN 'stale_read' WHEN r IS NOT NULL THEN 'repeated_read' ELSE 'wanted_read' END AS strategy, CASE WHEN coalesce(e, r) IS NULL THEN 'keep' ELSE 'drop' END AS label, count(*) AS n FROM n GROUP BY ALL""")
def mined_rereads(spark, sf_dir):
    """Proposals mined from the flattened sessions: reads of files that are edited or read again later."""
    m = transcripts.mined_rereads(transcripts.transcript_segments(_sessions(spark, sf_dir), "conv_id", "i", "line"), "conv_id")
    return m.groupBy("conv_id", "path", "strategy", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS}, x AS (SELECT conv_id, i::DOUBLE AS spot, 1 AS own, text FROM turns UNION ALL SELECT conv_id, 1, 0, 'noise ' || conv_id FROM (SELECT DISTINCT conv_id FROM turns) UNION ALL SELECT conv_id, 9999, 0, 'noise end' FROM (SELECT DISTINCT conv_id FROM turns))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot, own, text) - 1 AS place, md5(text) AS digest, own = 0 AS inserted FROM x""")
def stitched_noise(spark, sf_dir):
    t = _turns(spark, sf_dir)
    ids = t.select("conv_id").distinct()
    noise = ids.select("conv_id", F.lit(1).alias("at"), F.concat(F.lit("noise "), "conv_id").alias("text")).unionByName(ids.select("conv_id", F.lit(9999).alias("at"), F.lit("noise end").alias("text")))
    s = transcripts.stitched(t, noise, "conv_id", "i")
    return s.select("conv_id", F.col("place").cast("long").alias("place"), F.md5("text").alias("digest"), "inserted")


@query("""WITH r AS (SELECT doc_id, quality AS label, md5(text) AS h FROM documents JOIN labels USING (doc_id)), b AS (SELECT h FROM r GROUP BY h HAVING count(DISTINCT label) > 1) SELECT doc_id, label FROM r JOIN b USING (h)""")
def contrast_records(spark, sf_dir):
    """Labelled documents whose very text also has the other label."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("place"), "text")
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("place"), F.col("quality").alias("label"))
    return transcripts.contrast_records(d, "doc_id", "place", "text", l).select("doc_id", "label")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, ['train', 'train', 'train', 'calibration', 'test'][CAST((k + 17) % 5 AS INT) + 1] AS split FROM r""")
def group_position_split(spark, sf_dir):
    """A fixed cycle of splits dealt by position within a family, from an offset by seed; places come from ranges."""
    cycle, seed = ("train", "train", "train", "calibration", "test"), 17
    d = ranks.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], "k")
    return d.select("doc_id", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("k") - 1 + abs(seed), F.lit(len(cycle))) + 1).cast("int")).alias("split"))


@query(f"""WITH {TURNS}, c AS (SELECT conv_id, string_agg('<' || role || '>' || text, chr(10) ORDER BY i) AS prompt FROM turns GROUP BY 1)
SELECT conv_id, CAST(len(regexp_extract_all(prompt, '[[:alnum:]_]+|[^[:alnum:]_\\s]')) AS INT) AS tokens FROM c WHERE len(regexp_extract_all(prompt, '[[:alnum:]_]+|[^[:alnum:]_\\s]')) <= 400""".replace("[[:alnum:]_]", r"[\p{L}\p{N}_]").replace("[^[:alnum:]_\\s]", r"[^\p{L}\p{N}_\s]"))
def compiled_length_filter(spark, sf_dir):
    """Conversations whose compiled prompt has at most 400 tokens, a token being a word or a mark."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", F.concat(F.lit("<"), "role", F.lit(">"), "text").alias("line")))).alias("t"))
    c = c.select("conv_id", text.compiled_tokens(F.array_join(F.transform("t", lambda x: x["line"]), "\n")).alias("tokens"))
    return c.filter("tokens <= 400")


@query("""SELECT user_id AS symbol, epoch_us(date_trunc('second', ts)) * 1000 AS obs_ns, round(value, 6) AS value FROM events WHERE event_type = 'view'""")
def metrics_scan(spark, sf_dir):
    """Metrics files with UTC stamps in text, written per symbol with their header and read back."""
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    path = fresh_path(spark, "metrics")
    line = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.col("user_id").alias("symbol"), F.lit(1.0).alias("open_interest"), F.col("value").alias("open_interest_value"))
    line.write.option("header", True).csv(path)
    return rounded(readers.read_metrics(spark, path).select(F.col("symbol").cast("long").alias("symbol"), "obs_ns", "value"))


@query("""SELECT user_id AS symbol, epoch_us(ts) // 1000 AS calc_time, round(value, 6) AS rate, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, value) AS before FROM events WHERE event_type = 'purchase'""")
def settled_scan(spark, sf_dir):
    """Settlement files read back, each with the settlement before it."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    path = fresh_path(spark, "settled")
    e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("calc_time"), F.lit(8).alias("interval_hours"), F.col("value").alias("last_funding_rate"), F.col("user_id").alias("symbol")).write.option("header", True).csv(path)
    s = readers.read_settled(spark, path).withColumn("symbol", F.col("symbol").cast("long"))
    return rounded(s.select("symbol", "calc_time", "rate", F.lag("calc_time").over(Window.partitionBy("symbol").orderBy("calc_time", "rate")).alias("before")))


@query(f"""WITH {PANEL}, g AS (SELECT dn, avg(close) AS m FROM panel GROUP BY dn), b AS (SELECT dn, m > lag(m) OVER (ORDER BY dn) AS gate FROM g) SELECT asset, p.dn AS day, gate FROM panel p JOIN b USING (dn) WHERE gate IS NOT NULL""")
def day_gate_lookup(spark, sf_dir):
    """Each row with its day's market gate; days without one are dropped. A row a day is broadcast."""
    p = panel(spark, sf_dir).select("asset", "dn", "close")
    g = p.groupBy("dn").agg(F.avg("close").alias("m"))
    gate = g.select("dn", (F.col("m") > F.lag("m").over(Window.orderBy("dn"))).alias("gate")).filter("gate is not null")
    return p.join(F.broadcast(gate), "dn").select("asset", F.col("dn").alias("day"), "gate")


DAILY = f"""{PANEL}, k AS (SELECT asset, dn, close, count(*) OVER (PARTITION BY dn) AS n, row_number() OVER (PARTITION BY dn ORDER BY close, asset) AS k FROM panel WHERE close > 0),
d AS (SELECT dn, i, lag(dn) OVER (ORDER BY dn) AS before FROM (SELECT dn, row_number() OVER (ORDER BY dn) AS i FROM (SELECT DISTINCT dn FROM panel))),
book AS (SELECT dn, asset, CASE WHEN k <= 2 THEN 'short' ELSE 'long' END AS side FROM k WHERE n >= 6 AND (k <= 2 OR k > n - 2)),
legs AS (SELECT d.dn, b.asset, b.side, e.close AS entry, (SELECT arg_max(x.close, x.dn) FROM panel x WHERE x.asset = b.asset AND x.dn <= d.dn) AS exit FROM d JOIN book b ON b.dn = d.before LEFT JOIN panel e ON e.asset = b.asset AND e.dn = d.before),
r AS (SELECT dn, sum(CASE WHEN entry > 0 AND exit > 0 THEN CASE side WHEN 'long' THEN 1 ELSE -1 END * (exit / entry - 1) * 10000 END) / 4 AS gross, count(*) AS legs, count(CASE WHEN entry > 0 AND exit > 0 THEN 1 END) AS priced FROM legs GROUP BY dn),
c AS (SELECT d.dn, (SELECT count(*) FROM (SELECT asset, side FROM book WHERE dn = d.dn EXCEPT SELECT asset, side FROM book WHERE dn = d.before)) AS ins, (SELECT count(*) FROM (SELECT asset, side FROM book WHERE dn = d.before EXCEPT SELECT asset, side FROM book WHERE dn = d.dn)) AS outs FROM d)"""


@query(f"""WITH {DAILY}, l AS (SELECT d.dn, EXISTS (SELECT 1 FROM book b WHERE b.dn = d.dn) AS rebalanced, greatest(ins, outs) AS changed, greatest(ins, outs) / 4.0::DOUBLE * 5 AS cost, CASE WHEN coalesce(legs, 0) = 0 THEN 0 WHEN priced = legs THEN gross END AS gross FROM d JOIN c USING (dn) LEFT JOIN r USING (dn))
SELECT dn AS day, CASE WHEN rebalanced THEN 'rebalance' ELSE 'skipped_insufficient_universe' END AS event, CAST(changed AS BIGINT) AS changed, round(cost, 6) AS cost_bps, round(gross, 4) AS gross_bps, round(gross - cost, 4) AS net_bps, round(coalesce(sum(gross) OVER (ORDER BY dn), 0) - sum(cost) OVER (ORDER BY dn), 4) AS booked_bps FROM l""")
def daily_book_ledger(spark, sf_dir):
    """The cross-sectional book of each day, two names a side: legs changed, their cost, and what the book before made;
    an incomplete fill makes nothing."""
    out = books.daily_ledger(panel(spark, sf_dir).select("asset", "dn", "close"), "dn", "asset", "close", "close", edge=2, least=6, cost_bps=5.0)
    return out.select(F.col("dn").alias("day"), "event", "changed", F.round("cost_bps", 6).alias("cost_bps"), *[F.round(c, 4).alias(c) for c in ("gross_bps", "net_bps", "booked_bps")])


@query(f"""WITH {PANEL}, k AS (SELECT asset, dn, close, count(*) OVER (PARTITION BY dn) AS n, row_number() OVER (PARTITION BY dn ORDER BY close, asset) AS k FROM panel), b AS (SELECT dn, asset, close, CASE WHEN k <= 2 THEN 'short' WHEN k > n - 2 THEN 'long' END AS leg FROM k WHERE n >= 6)
SELECT dn AS day, asset, leg FROM (SELECT *, min(close) FILTER (leg = 'long') OVER (PARTITION BY dn) > max(close) FILTER (leg = 'short') OVER (PARTITION BY dn) AS fine FROM b) WHERE fine AND leg IS NOT NULL""")
def top_two_book(spark, sf_dir):
    return books.legs(panel(spark, sf_dir), "dn", "asset", "close", least=6, edge=2).select(F.col("dn").alias("day"), "asset", "leg")


@query(f"""WITH {PANEL}, h AS (SELECT a.asset, a.dn, a.close, a.qv, list_sort(list(b.close)) AS h, list_sort(list(b.qv)) AS g FROM panel a JOIN panel b ON a.asset = b.asset AND b.dn < a.dn GROUP BY 1, 2, 3, 4),
l AS (SELECT p.asset, p.dn, CASE WHEN len(h) >= 5 AND p.close > h[CAST(round_even(0.75::DOUBLE * (len(h) - 1), 0) AS INT) + 1] THEN 'high' WHEN len(h) >= 5 AND p.qv < g[CAST(round_even(0.25::DOUBLE * (len(h) - 1), 0) AS INT) + 1] THEN 'thin' ELSE 'normal' END AS label FROM panel p LEFT JOIN h USING (asset, dn)),
n AS (SELECT *, label IS DISTINCT FROM lag(label) OVER w AS new FROM l WINDOW w AS (PARTITION BY asset ORDER BY dn))
SELECT asset, label, dn AS start, lead(dn) OVER (PARTITION BY asset ORDER BY dn) AS "end" FROM n WHERE new""")
def causal_regimes(spark, sf_dir):
    """Regime windows by expanding quantiles of strictly earlier days, the first firing label by priority."""
    p = panel(spark, sf_dir).select("asset", "dn", "close", "qv")
    p = windows.expanding_quantile_flag(p, "asset", "dn", "close", 0.75, 5, "high", rounded_rank=True)
    p = windows.expanding_quantile_flag(p, "asset", "dn", "qv", 0.25, 5, "thin", below=True, rounded_rank=True)
    known = F.col("asset").isNotNull()  # events without a user are no asset with earlier days
    p = p.withColumn("label", F.when(known & F.col("high"), "high").when(known & F.col("thin"), "thin").otherwise("normal"))
    return windows.collapse_runs(p, "asset", "dn", "label")


@query("""WITH h AS (SELECT doc_id, substring(md5(CAST(doc_id AS VARCHAR)), 1, 9) AS b FROM documents), f AS (SELECT doc_id, list_transform([[1,2,3,4,5,6,7,8,9],[7,4,1,8,5,2,9,6,3],[9,8,7,6,5,4,3,2,1],[3,6,9,2,5,8,1,4,7],[3,2,1,6,5,4,9,8,7],[7,8,9,4,5,6,1,2,3],[1,4,7,2,5,8,3,6,9],[9,6,3,8,5,2,7,4,1]], lambda p: array_to_string(list_transform(p, lambda i: b[i]), '')) AS forms FROM h)
SELECT doc_id, list_min(forms) AS board FROM f""")
def board_symmetry(spark, sf_dir):
    """A board of nine cells as the least of its eight turns and mirror images."""
    b = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 9)
    return table(spark, sf_dir, "documents").select("doc_id", text.canonical_board(b, 3).alias("board"))


@query("""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, array_to_string(list_transform(list_distinct([substring(t, 1, 60), substring(t, greatest(1, n // 2 - 29), 60), substring(t, greatest(1, n - 59), 60)]), lambda x: md5(x)).list_sort(), ',') AS signatures FROM n WHERE n >= 40""")
def signature_digests(spark, sf_dir):
    """Start, middle and end of each long enough text, as digests."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).filter(F.length("t") >= 40)
    return d.select("doc_id", F.array_join(F.array_sort(F.transform(text.signatures(F.col("t")), lambda x: F.md5(x.cast("binary")))), ",").alias("signatures"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\x{AC00}-\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh' ELSE 'other' END AS bucket,
  CASE WHEN length(text) >= 10 THEN (length(text) - 10) // 6 + 1 END AS windows FROM documents""")
def script_buckets(spark, sf_dir):
    """The script of each text, and how many windows of ten characters it has."""
    t = F.col("text")
    windows_ = F.size(text.char_windows(t))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.language_bucket(t), F.lit("other")).alias("bucket"), F.when(windows_ > 0, windows_).cast("long").alias("windows"))


@query(f"""WITH {SCORED}, g AS (SELECT (id % 3) || '|' || (id % 40) AS c, count(*) AS n, sum(u - p) AS k FROM scored GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS m FROM g),
d AS (SELECT r.b, CAST(('0x' || substring(sha256('nest|' || r.b || '|' || j.j), 1, 8)) AS BIGINT) % (SELECT max(m) FROM o) AS i FROM range(100) r(b), range((SELECT max(m) FROM o)) j(j)),
e AS (SELECT d.b, sum(k) / sum(n) AS mean FROM d JOIN o USING (i) GROUP BY d.b) SELECT count(*) AS samples, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM e""")
def nested_bootstrap(spark, sf_dir):
    """Units of (seed, group) drawn together for both arms."""
    s = scored(spark, sf_dir).withColumn("unit", F.concat_ws("|", (F.col("id") % 3).cast("string"), (F.col("id") % 40).cast("string")))
    e = resample.paired_bootstrap(s, "unit", "p", "u", 100, "nest")
    return rounded(e.agg(F.count("*").alias("samples"), F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")))


@query("""SELECT count(*) AS rows, true AS same, false AS changed_same FROM orders""")
def canonical_receipt(spark, sf_dir):
    """A table's receipt over canonical rows: the same in another order and without its run time, another when one value
    of one row changes."""
    o = table(spark, sf_dir, "orders").withColumn("run_at", F.lit("a"))
    other = o.repartition("o_custkey").withColumn("run_at", F.lit("b")).select(*reversed(o.columns))
    last = o.agg(F.max("o_orderkey").alias("last"))
    changed = o.join(F.broadcast(last)).withColumn("o_orderstatus", F.when(F.col("o_orderkey") == F.col("last"), "?").otherwise(F.col("o_orderstatus"))).drop("last")
    a, b, c = (sinks.canonical_receipt(x, drop=["run_at"]).select("rows", F.col("identity").alias(n)) for x, n in ((o, "a"), (other, "b"), (changed, "c")))
    return a.join(F.broadcast(b.drop("rows"))).join(F.broadcast(c.drop("rows"))).select("rows", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("changed_same"))
