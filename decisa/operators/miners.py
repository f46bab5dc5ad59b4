"""Outcome mining: which earlier segments of a session a later one provably used, and the window that shows it.

Units of evidence (URLs, hashes, rare identifiers, paths, phrases) of all segments form an inverted index by session and
unit; in it, a running window finds the first later use of each. So a segment is never compared with another one, however
long a session is: work follows the number of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.functions.text import EXTRACTORS
from decisa.operators.transcripts import tool_ops

USED_BY = ("assistant_text", "user_turn", "tool_use")
URL = EXTRACTORS["url"]
HASH = r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{7,40}\b"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{7,39}"
#: What makes an identifier no plain word, besides a length of 12.
SHAPED = r"_|[0-9]|[a-z][A-Z]"
RARE, PHRASE = 3, 6
STRENGTH = {"url": "strong", "path": "strong", "phrase": "strong", "hash": "strong", "short_hash": "medium", "directory": "weak", "identifier": "weak"}


def _each(df: DataFrame, key: str, kind: str, found: Column) -> DataFrame:
    return df.select(key, "place", F.col("kind").alias("of"), F.lit(kind).alias("unit_kind"), F.explode(F.array_distinct(found)).alias("unit"))


def _phrases(text: Column, words: int) -> Column:
    """Every run of some words with one of five letters or more, in lower case."""

    def runs(w: Column) -> Column:
        return F.transform(F.when(F.size(w) >= words, F.sequence(F.lit(1), F.size(w) - words + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(w, i, words))

    # the words are an item of a list, so that a text is split once and not again for each run
    split = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    found = F.flatten(F.transform(F.array(split), runs))
    return F.transform(F.filter(found, lambda r: F.exists(r, lambda x: F.length(x) >= 5)), lambda r: F.array_join(r, " "))


def evidence_units(segments: DataFrame, key: str, rare: int = RARE, words: int = PHRASE) -> DataFrame:
    """(key, place, of, unit_kind, unit): the units of evidence of all segments, each once a segment; `of` is its kind.

    An identifier counts if it is shaped like a name and in at most `rare` segments of its session. Phrases are of user
    turns and assistant texts."""
    text = F.coalesce("text", F.lit(""))
    s = segments.select(key, "place", "kind", text.alias("text"))
    urls = F.transform(F.regexp_extract_all("text", F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))
    hashes = F.regexp_extract_all("text", F.lit(HASH), F.lit(0))
    names = F.filter(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), lambda w: w.rlike(SHAPED) | (F.length(w) >= 12))
    marked = _each(s, key, "identifier", F.transform(names, F.lower))
    marked = marked.withColumn("_n", F.count("*").over(Window.partitionBy(key, "unit"))).filter(F.col("_n") <= rare).drop("_n")
    said = s.filter("kind in ('user_turn', 'assistant_text')")
    parts = [
        _each(s, key, "url", urls), _each(s, key, "hash", F.filter(hashes, lambda h: F.length(h) >= 10)), _each(s, key, "short_hash", F.filter(hashes, lambda h: F.length(h) < 10)),
        marked, _each(said, key, "phrase", _phrases(F.col("text"), words)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_units(segments: DataFrame, key: str) -> DataFrame:
    """(key, place, of, unit_kind, unit): paths of tool results, which their calls read or listed, and of calls that edit.

    A result is that of the oldest call of its session without one. A listing gives the directory, an edit the path and
    its directory."""
    order = Window.partitionBy(key, "kind").orderBy("place")
    calls = segments.filter("kind = 'tool_use'").withColumn("_k", F.row_number().over(order))
    results = segments.filter("kind = 'tool_result'").withColumn("_k", F.row_number().over(order)).select(key, "_k", F.col("place").alias("_result"))
    ops = calls.select(key, "place", "_k", F.inline(tool_ops(F.col("text")))).select(key, "place", "_k", "op", F.explode("paths").alias("unit")).distinct()
    mine = ops.filter("op <> 'edit'").join(results.filter("_result is not null"), [key, "_k"]).filter("_result > place")
    of_results = mine.select(key, F.col("_result").alias("place"), F.lit("tool_result").alias("of"), F.when(F.col("op") == "read", "path").otherwise("directory").alias("unit_kind"), F.regexp_replace("unit", "/+$", "").alias("unit"))
    edits = ops.filter("op = 'edit'").select(key, "place", F.lit("tool_use").alias("of"), F.inline(F.array(F.struct(F.lit("path").alias("unit_kind"), F.col("unit").alias("unit")), F.struct(F.lit("directory").alias("unit_kind"), F.regexp_replace("unit", "/[^/]*$", "").alias("unit")))))
    return of_results.unionByName(edits)


def first_uses(units: DataFrame, key: str, candidates: tuple[str, ...] = ("tool_result", "user_turn")) -> DataFrame:
    """(key, place, of, usage, unit_kind, unit, strength): of each candidate segment that a later one uses, the strongest
    link, then the earliest use. An edit uses paths and directories, USED_BY kinds the other units."""
    later = Window.partitionBy(key, "unit_kind", "unit").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, -1)
    uses = F.when(F.col("unit_kind").isin("path", "directory"), F.col("of") == "tool_use").otherwise(F.col("of").isin(*USED_BY))
    found = units.withColumn("usage", F.min(F.when(uses, F.col("place"))).over(later)).filter(F.col("usage").isNotNull() & F.col("of").isin(*candidates))
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])[F.col("unit_kind")]
    rank = F.when(strength == "strong", 0).when(strength == "medium", 1).otherwise(2)
    link = F.struct(rank.alias("rank"), "usage", "unit_kind", "unit")
    best = found.groupBy(key, "place", "of").agg(F.min(link).alias("l"))
    named = F.create_map(*[F.lit(x) for pair in enumerate(("strong", "medium", "weak")) for x in pair])[F.col("l.rank")]
    return best.select(key, "place", "of", "l.usage", "l.unit_kind", "l.unit", named.alias("strength"))


def outcome_windows(segments: DataFrame, uses: DataFrame, key: str, budget: int) -> DataFrame:
    """`uses` with (anchor, first, bytes, window): the part of the session, up to the use, that fits a budget of bytes.

    anchor: the last user turn at or before the use; a use without one is left out. The candidate, the anchor and the use
    are always shown; the segments before the use are shown as far back as the rest of the budget allows, from `first` on.
    window writes the islands of shown segments as `from-to`, and a gap between two as `[n omitted]`. bytes counts what is
    shown, which is above the budget only when the three alone are."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    order = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = segments.select(key, "place", "kind", size.alias("size"))
    s = s.withColumns({"upto": F.sum("size").over(order), "anchor": F.max(F.when(F.col("kind") == "user_turn", F.col("place"))).over(order)})
    at = s.select(key, F.col("place").alias("usage"), F.col("upto").alias("usage_upto"), F.col("size").alias("usage_size"), "anchor")
    own = lambda name: s.select(key, F.col("place").alias(name), F.col("size").alias(f"{name}_size"), F.col("upto").alias(f"{name}_upto"))
    u = uses.join(at.filter("anchor is not null"), [key, "usage"]).join(own("place"), [key, "place"]).join(own("anchor"), [key, "anchor"])
    # both may lie inside the run before the use, then they are counted twice and the run is somewhat shorter
    fixed = F.col("usage_size") + F.col("place_size") + F.when(F.col("anchor").isin(F.col("usage"), F.col("place")), 0).otherwise(F.col("anchor_size"))
    u = u.withColumn("floor", F.col("usage_upto") - F.col("usage_size") - F.greatest(F.lit(budget) - fixed, F.lit(0)))
    # the first segment that begins at or after the floor: both kinds of points in one order, read backwards
    points = s.select(key, (F.col("upto") - F.col("size")).alias("v"), F.lit(1).alias("_s"), F.col("place").alias("_p"), F.lit(None).cast(u.schema["place"].dataType).alias("place"))
    asks = u.select(key, F.col("floor").alias("v"), F.lit(0).alias("_s"), F.lit(None).cast(s.schema["place"].dataType).alias("_p"), "place")
    back = Window.partitionBy(key).orderBy(F.desc("v"), F.desc("_s"), F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = points.unionByName(asks).withColumn("first", F.last("_p", ignorenulls=True).over(back)).filter("_s = 0").select(key, "place", "first")
    u = u.join(firsts, [key, "place"]).withColumn("first", F.least("first", "usage"))
    begin = s.select(key, F.col("place").alias("first"), (F.col("upto") - F.col("size")).alias("first_from"))
    u = u.join(begin, [key, "first"])
    outside = lambda c: F.col(c) < F.col("first")
    low, high = F.least("place", "anchor"), F.greatest("place", "anchor")
    alone = F.array_sort(F.array_distinct(F.filter(F.array("place", "anchor"), lambda p: p < F.col("first"))))
    islands = F.concat(F.transform(alone, lambda p: F.struct(p.alias("from"), p.alias("to"))), F.array(F.struct(F.col("first").alias("from"), F.col("usage").alias("to"))))
    gap = lambda i: F.get(islands, i)["from"] - F.when(i == 0, F.lit(0)).otherwise(F.get(islands, i - 1)["to"] + 1)
    parts = F.transform(islands, lambda x, i: F.concat(F.when(gap(i) > 0, F.concat(F.lit("["), gap(i), F.lit(" omitted] "))).otherwise(F.lit("")), x["from"], F.lit("-"), x["to"]))
    shown = F.col("usage_upto") - F.col("first_from") + F.when(outside("place"), F.col("place_size")).otherwise(0) + F.when(outside("anchor") & (low < high), F.col("anchor_size")).otherwise(0)
    return u.select(*uses.columns, "anchor", "first", shown.alias("bytes"), F.array_join(parts, " ").alias("window"))


def mined_outcomes(segments: DataFrame, key: str, budget: int = 14_000) -> DataFrame:
    """(key, place, strategy, label, strength, unit_kind, unit, usage, anchor, first, bytes, window): every tool result and
    user turn that a later segment used.

    strategy: file_read_edit (the result of a read or a listing whose file is edited later), command_output_echo (a
    result's URL, hash or rare name comes again), user_requirement_echo. label: keep, uncertain where the link is weak.
    segments: transcript_segments(). A candidate that is its own anchor is left out, as are texts without units."""
    units = evidence_units(segments, key).unionByName(file_units(segments, key))
    u = outcome_windows(segments, first_uses(units, key), key, budget).filter("anchor <> place")
    strategy = F.when(F.col("unit_kind").isin("path", "directory"), "file_read_edit").when(F.col("of") == "user_turn", "user_requirement_echo").otherwise("command_output_echo")
    label = F.when(F.col("strength") == "weak", "uncertain").otherwise("keep")
    return u.select(key, "place", strategy.alias("strategy"), label.alias("label"), "strength", "unit_kind", "unit", "usage", "anchor", "first", "bytes", "window")
