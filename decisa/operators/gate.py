"""The active gate: segments of request bodies that a caller's policy and a scorer's answers let go are cut out by bytes.

Whatever isn't certain leaves the body as it came: a fault of the body, of the policy or of the scores, a segment that
another one needs, or a reduced body that doesn't read back as the segments that were to stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.json_values import values
from decisa.operators.removal import CUTS, removed_bytes, request_cuts
from decisa.operators.requests import parsed_requests
from decisa.session import materialize

# What a policy may say of a segment, and how many segments are scored together.
PROTECTION_FLAGS = ("pinned", "cited", "safety", "credential", "dependency", "exact_text")
NOTE_FIELDS = ("eligible", "depends_on", *PROTECTION_FLAGS)
SCORED_TOGETHER = 32

NOTES = "array<struct<pointer: string, object: boolean, flaw: boolean, eligible: boolean, flagged: boolean, needs: array<string>, needs_flaw: boolean>>"


def policies(df: DataFrame, key: str, sidecar: str) -> DataFrame:
    """(key, flaw, bypass, notes): each policy text read. flaw: it is no object of `segments` and `bypass`, or segments is
    none; notes has what it says of each pointer. A null policy says nothing. Keys are unique."""
    rows = df.select(key, F.coalesce(F.col(sidecar), F.lit("{}")).alias("_side"))
    v = values(rows, "_side", 4)
    p, lv, kind = (lambda k: F.get("path", F.lit(k - 1))), F.col("lv"), F.col("kind")
    note = (lv >= 2) & (p(1) == "segments")
    flag = note & (lv == 3) & p(3).isin("eligible", *PROTECTION_FLAGS)
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    item = note & (lv == 4) & (p(3) == "depends_on")
    text = F.when(F.instr("token", "\\") == 0, F.substring("token", F.lit(2), F.length("token") - 2)).otherwise(F.from_json(F.concat(F.lit('{"k":'), "token", F.lit("}")), "k string")["k"])
    by_pointer = v.withColumn("_p", F.when(note, p(2))).groupBy("_row", key, "_valid", "_p").agg(
        any_((lv == 0) & (kind != "object")).alias("_no_object"),
        any_((lv == 1) & (~p(1).isin("segments", "bypass") | ((p(1) == "segments") & (kind != "object")))).alias("_top"),
        any_((lv == 1) & (p(1) == "bypass") & ~((kind == "null") | (F.col("token") == "false") | ((kind == "number") & (F.col("token").try_cast("double") == 0)))).alias("_bypass"),
        F.struct(
            F.first("_p").alias("pointer"), any_((lv == 2) & (kind == "object")).alias("object"),
            (any_(note & (lv == 3) & ~p(3).isin(*NOTE_FIELDS)) | any_(flag & (kind != "boolean"))).alias("flaw"),
            any_(flag & (p(3) == "eligible") & (F.col("token") == "true")).alias("eligible"), any_(flag & (p(3) != "eligible") & (F.col("token") == "true")).alias("flagged"),
            F.collect_list(F.when(item & (kind == "string"), text)).alias("needs"),
            (any_(note & (lv == 3) & (p(3) == "depends_on") & (kind != "array")) | any_(item & (kind != "string"))).alias("needs_flaw"),
        ).alias("_note"),
    )
    g = by_pointer.groupBy("_row", key, "_valid").agg(any_(F.col("_no_object")).alias("_no_object"), any_(F.col("_top")).alias("_top"), any_(F.col("_bypass")).alias("bypass"), F.collect_list(F.when(F.col("_p").isNotNull(), F.col("_note"))).cast(NOTES).alias("notes"))
    return g.select(key, (~F.col("_valid") | F.col("_no_object") | F.col("_top")).alias("flaw"), "bypass", "notes")


def _closed(kept: Column, segments: Column) -> Column:
    """The pointers that kept ones need, at any distance, with them. A request has few segments, and each step adds one at
    least or changes nothing, so there are as many steps as segments with needs."""
    edges = F.filter(segments, lambda s: F.size(s["needs"]) > 0)
    steps = F.when(F.size(edges) > 0, F.sequence(F.lit(1), F.size(edges))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, kept, lambda known, _: F.array_union(known, F.flatten(F.transform(F.filter(edges, lambda s: F.array_contains(known, s["pointer"])), lambda s: s["needs"]))))


def _reasoned(segments: Column, needed: Column) -> Column:
    """Segments with a reason, where they had none and are among the needed pointers."""
    return F.transform(segments, lambda s: s.withField("reason", F.coalesce(s["reason"], F.when(F.array_contains(needed, s["pointer"]), "required_dependency"))))


def _held(segments: Column) -> Column:
    return F.transform(F.filter(segments, lambda s: s["reason"].isNotNull()), lambda s: s["pointer"])


def decided(parsed: DataFrame, policy: DataFrame, scores: DataFrame, key: str, threshold: float = 0.99) -> DataFrame:
    """(key, status, reason, segments, spans): what a gate decides of each parsed request.

    parsed: parsed_requests(); policy: policies(); scores: (key, pointer, p), p being the probability that a segment is
    irrelevant. status is bypass or scored. A bypass's reason: parsed_requests()'s; invalid_sidecar, caller_bypass,
    unknown_segment_reference, unresolved_dependency; missing_user_intent, no_eligible_segments; scorer_unavailable when
    a request has no score, invalid_score_response when its only batch of candidates has one that isn't scored just once
    within [0, 1]; all_batches_failed. A scored one's: shadow_only, or partial_batch_fallback when some batches failed.

    A segment's reason to stay: protected_structure, caller_protected, not_explicitly_eligible, required_dependency,
    batch_fallback, model_retain (p at most 1 - threshold), uncertain_score (p below it); whole_request_fallback in a
    bypass. The others are high_irrelevance_score. Keys are unique and not null."""
    if not 0.5 < threshold <= 1:
        raise ValueError("a threshold is above 0.5 and at most 1")
    said = scores.groupBy(key).agg(F.collect_list(F.struct("pointer", F.col("p").cast("double").alias("p"))).alias("_scores"))
    rows = parsed.join(policy, key, "left").join(said, key, "left")
    none = F.lit(None).cast("string")
    note = lambda s: F.get(F.filter("notes", lambda n: n["pointer"] == s["pointer"]), F.lit(0))
    noted = F.transform("segments", lambda s, k: s.withField("place", k).withField("note", note(s)).withField("needs", F.coalesce(note(s)["needs"], F.array().cast("array<string>"))))
    rows = rows.withColumns({"notes": F.coalesce("notes", F.array().cast(NOTES)), "_scores": F.coalesce("_scores", F.array().cast("array<struct<pointer: string, p: double>>"))})
    rows = rows.withColumn("_s", noted)
    pointers = F.transform("_s", lambda s: s["pointer"])
    flaws = F.transform("_s", lambda s: F.when(s["note"]["flaw"] | ~s["note"]["object"], F.lit("invalid_sidecar")).when(s["note"]["needs_flaw"] | (F.size(F.array_except(s["needs"], pointers)) > 0), F.lit("unresolved_dependency")))
    policy_fault = (
        F.when(F.coalesce("flaw", F.lit(False)), "invalid_sidecar").when(F.coalesce("bypass", F.lit(False)), "caller_bypass")
        .when(F.size(F.array_except(F.transform("notes", lambda n: n["pointer"]), pointers)) > 0, "unknown_segment_reference")
        .otherwise(F.get(F.filter(flaws, lambda f: f.isNotNull()), F.lit(0)))
    )
    rows = rows.withColumn("_fault", F.coalesce("reason", policy_fault))
    own = lambda s: F.when(s["protected"] | s["text"].isNull(), "protected_structure").when(F.coalesce(s["note"]["flagged"], F.lit(False)), "caller_protected").when(~F.coalesce(s["note"]["eligible"], F.lit(False)), "not_explicitly_eligible")
    rows = rows.withColumn("_s", F.when(F.col("_fault").isNull(), F.transform("_s", lambda s: s.withField("reason", own(s)))).otherwise(F.transform("_s", lambda s: s.withField("reason", none))))
    rows = rows.withColumn("_s", _reasoned(F.col("_s"), _closed(_held(F.col("_s")), F.col("_s"))))
    rows = rows.withColumn("_candidates", F.transform(F.filter("_s", lambda s: s["reason"].isNull()), lambda s: s["pointer"]))
    score = lambda pointer: F.filter("_scores", lambda x: x["pointer"] == pointer)
    valid = lambda pointer: F.coalesce((F.size(score(pointer)) == 1) & (F.get(score(pointer), F.lit(0))["p"] >= 0) & (F.get(score(pointer), F.lit(0))["p"] <= 1), F.lit(False))
    batches = F.ceil(F.size("_candidates") / SCORED_TOGETHER).cast("int")
    wrong = F.array_distinct(F.filter(F.transform("_candidates", lambda c, k: F.when(~valid(c), F.floor(k / SCORED_TOGETHER).cast("int"))), lambda b: b.isNotNull()))
    rows = rows.withColumns({"_batches": batches, "_wrong": wrong})
    users = F.exists("_s", lambda s: (s["role"] == "user") & s["text"].isNotNull())
    stops = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(~users, "missing_user_intent").when(F.size("_candidates") == 0, "no_eligible_segments").when(F.size("_scores") == 0, "scorer_unavailable")
        .when(F.size("_wrong") == F.col("_batches"), F.when(F.col("_batches") == 1, "invalid_score_response").otherwise("all_batches_failed"))
    )
    rows = rows.withColumn("_stop", stops)
    batch = lambda s: F.floor((F.array_position("_candidates", s["pointer"]) - 1) / SCORED_TOGETHER).cast("int")
    p = lambda s: F.get(score(s["pointer"]), F.lit(0))["p"]
    late = lambda s: F.when(F.array_contains("_wrong", batch(s)), "batch_fallback").when(p(s) <= 1 - threshold, "model_retain").when(p(s) < threshold, "uncertain_score")
    scored = F.transform("_s", lambda s: s.withField("p", F.when(s["reason"].isNull() & ~F.array_contains("_wrong", batch(s)), p(s))).withField("reason", F.coalesce(s["reason"], late(s))))
    given_up = F.transform("_s", lambda s: s.withField("p", F.lit(None).cast("double")).withField("reason", F.coalesce(s["reason"], F.lit("whole_request_fallback"))))
    rows = rows.withColumn("_s", F.when(F.col("_stop").isNull(), scored).otherwise(given_up))
    rows = rows.withColumn("_s", _reasoned(F.col("_s"), _closed(_held(F.col("_s")), F.col("_s"))))
    out = F.transform("_s", lambda s: s.withField("reason", F.coalesce(s["reason"], F.lit("high_irrelevance_score"))).dropFields("note", "needs", "place"))
    reason = F.coalesce("_stop", F.when(F.size("_wrong") > 0, "partial_batch_fallback").otherwise("shadow_only"))
    return rows.select(key, F.when(F.col("_stop").isNull(), "scored").otherwise("bypass").alias("status"), reason.alias("reason"), out.alias("segments"), "spans")


def active_gate(df: DataFrame, scores: DataFrame, key: str, raw: str, format_: str, sidecar: str, threshold: float = 0.99) -> DataFrame:
    """(key, status, reason, applied, forwarded, held, receipt): bodies as a gate sends them on.

    forwarded is the body without the segments that decided() lets go, or the body as it came; held has the cut bytes,
    which the caller keeps and removal.restored_bytes() puts back. applied tells whether anything was cut: not in a
    bypass, when nothing is to go, or with reason reduced_request_would_be_empty, or reduced_request_differs when the
    reduced body doesn't parse into just the segments that stay. A null or repeated key is a bypass with ambiguous_key.

    receipt has no content: sizes and SHA-256 of both bodies and of each cut, and for each segment pointer, role, SHA-256
    of its value's bytes, suggestion, reason, p and applied."""
    body = F.coalesce(F.col(raw), F.lit("")).cast("string")
    rows = df.select(key, F.col(format_).alias("_wire"), body.alias("_raw"), F.col(sidecar).alias("_sidecar"), (F.col(key).isNull() | (F.count("*").over(Window.partitionBy(key)) > 1)).alias("_twice"))
    rows = materialize(rows, "gate")
    sure = rows.filter(~F.col("_twice"))
    state = decided(parsed_requests(sure, key, "_raw", "_wire"), policies(sure, key, "_sidecar"), scores, key, threshold)
    gone = F.transform(F.filter("segments", lambda s: s["reason"] == "high_irrelevance_score"), lambda s: s["pointer"])
    state = state.withColumn("_gone", F.when(F.col("status") == "scored", gone).otherwise(F.array().cast("array<string>")))
    state = state.withColumn("_cuts", F.when(F.size("_gone") > 0, request_cuts(F.col("spans"), F.col("_gone"))).otherwise(F.array().cast(CUTS))).drop("spans")
    state = sure.join(state, key).withColumn("_cut", removed_bytes(F.col("_raw"), F.col("_cuts")))
    state = materialize(state, "gate")
    again = parsed_requests(state.filter("size(_gone) > 0 and _cuts is not null").select(key, "_wire", F.col("_cut.reduced").cast("string").alias("_reduced")), key, "_reduced", "_wire")
    shape = lambda segments: F.transform(segments, lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"), s["protected"].alias("protected")))
    state = state.join(again.select(key, shape(F.col("segments")).alias("_left"), F.col("reason").alias("_again")), key, "left")
    stays = shape(F.filter("segments", lambda s: ~F.array_contains("_gone", s["pointer"])))
    same = F.coalesce(F.col("_again").isNull() & (F.col("_left") == stays), F.lit(False))
    wanted = F.size("_gone") > 0
    late = F.when(wanted & F.col("_cuts").isNull(), "reduced_request_would_be_empty").when(wanted & ~same, "reduced_request_differs")
    applied = wanted & late.isNull()
    whole = F.col("_raw").cast("binary")
    nothing = F.array().cast("array<struct<start: bigint, stop: bigint, sha256: string>>")
    state = state.withColumns({"applied": applied, "_late": late})
    forwarded = F.when(F.col("applied"), F.col("_cut.reduced")).otherwise(whole)
    value = lambda s: F.substring(whole, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
    segments = F.transform(
        "segments",
        lambda s: F.struct(
            s["pointer"].alias("pointer"), s["role"].alias("role"), F.sha2(value(s), 256).alias("sha256"), F.when(s["reason"] == "high_irrelevance_score", "drop").otherwise("retain").alias("suggestion"),
            s["reason"].alias("reason"), s["p"].alias("p"), (F.col("applied") & F.array_contains("_gone", s["pointer"])).alias("applied"),
        ),
    )

    def receipt(cuts: Column, said: Column) -> Column:
        return F.struct(
            F.octet_length(whole).cast("long").alias("bytes"), F.sha2(whole, 256).alias("sha256"), F.octet_length("forwarded").cast("long").alias("reduced_bytes"),
            F.sha2("forwarded", 256).alias("reduced_sha256"), cuts.alias("cuts"), said.alias("segments"),
        )

    state = state.withColumn("forwarded", forwarded)
    known = state.select(
        key, F.when(F.col("_late").isNotNull(), "bypass").otherwise(F.col("status")).alias("status"), F.coalesce("_late", "reason").alias("reason"), "applied", "forwarded",
        F.when(F.col("applied"), F.col("_cut.held")).otherwise(F.array().cast("array<binary>")).alias("held"), receipt(F.when(F.col("applied"), F.col("_cut.manifest.cuts")).otherwise(nothing), segments).alias("receipt"),
    )
    empty = F.array().cast(known.schema["receipt"].dataType["segments"].dataType)
    unsure = rows.filter("_twice").withColumn("forwarded", whole)
    unsure = unsure.select(key, F.lit("bypass").alias("status"), F.lit("ambiguous_key").alias("reason"), F.lit(False).alias("applied"), "forwarded", F.array().cast("array<binary>").alias("held"), receipt(nothing, empty).alias("receipt"))
    return known.unionByName(unsure)
