"""Mixing sources to target weights by hash-threshold histograms.

A source whose target is k times its size and a remainder takes every row k times, and once more the rows whose hash
lies below a threshold. The threshold is found without sorting: sizes are summed by source and the leading bits of
the hash, the bucket in which the running sum passes the remainder is refined by the next bits, and so on; only rows
in that bucket are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.session import materialize

#: Hex digits of the hash that each level adds: 4,096 buckets a source and level, 48 bits in all.
LEVELS = (3, 3, 3, 3)
WEIGHTS = (3.0, 1.0, 2.0)
#: A table of sources up to this number of rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """The number of runs of bytes outside 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with target.

    Sources by code point, null last, take the weights in turn and share `share` of all sizes; a target stops at
    `most` times its source's size and the excess is shared again by weight among the rest until none is above. Which
    stop follows from one sorted pass: with water level t, a source gets min(weight * t, most * size), so it stops
    when t reaches most * size / weight. The rows here are sources; their running sums need one order.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(order) - 1) % len(weights)
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(table, (place + 1).cast("int"))).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = s.withColumn("stops", F.col("cap") / F.col("weight"))
    every, below = Window.partitionBy(), Window.orderBy("stops", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / rest
    s = s.withColumn("level", level).withColumn("free", F.col("level") <= F.col("stops"))
    water = F.min(F.when(F.col("free"), F.struct("stops", "level"))).over(every).getField("level")
    return s.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("water").isNull() | (F.col("stops") < F.col("water")), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target")
    )


def _joined(rows: DataFrame, table: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """rows with the row of their source, nulls with nulls."""
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    table = table.withColumn("of", key).drop("source")
    if count <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    return rows.withColumn("of", key).join(table, "of", how).drop("of")


def _digest(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, sum(LEVELS))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: doc_id, source, size and hash of every row. plan, a row a source: source_size, target,
    full copies of every row, and the threshold below which the hash of a row gives it one copy more."""
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _digest(F.col("doc_id")).alias("hash"))
    rows = materialize(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("full", full).withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
    targets = materialize(targets, "targets")
    n = targets.count()
    open_ = targets.select("source", "left", F.lit("").alias("prefix"))
    digits = 0
    for step in LEVELS:
        digits += step
        inside = _joined(rows, open_, n).filter(F.col("hash").startswith(F.col("prefix")))
        sums = inside.groupBy("source", "prefix", "left", F.substring("hash", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(run)).filter(F.col("upto") > F.col("left"))
        found = sums.groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "left")).alias("b"))
        found = found.select("source", F.col("b.bucket").alias("prefix"), (F.col("b.left") - F.col("b.upto") + F.col("b.size")).alias("left"), F.col("b.size").alias("within"))
        open_ = materialize(found, "thresholds")
    # below the threshold: all; in the last bucket: all of it where that is nearer; no threshold: the whole source fits
    cut = open_.select("source", F.col("prefix").alias("at"), (F.col("within") - F.col("left") < F.col("left")).alias("nearer"))
    return rows, materialize(_joined(targets, cut, n, "left"), "plan")


def _copies(hash_: Column, plan: str = "") -> Column:
    full, left, at, nearer = (F.col(plan + c) for c in ("full", "left", "at", "nearer"))
    more = F.when(at.isNull(), left > 0).otherwise((hash_ < at) | ((hash_ == at) & nearer))
    return full + more.cast("long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    size counts words (null text: 0); taken is size times the row's number of copies in the mix. Rows of one doc_id
    fall on the same side of a threshold, and so do all rows without one. Null sources are one source; sources of size 0 get target 0. Rows whose
    hash is in the last, finest bucket are taken when that brings the source nearer to its target. Empty in, empty
    out; other columns are not read.
    """
    rows, plan = mix_plan(docs, weights, share, most)
    both = _joined(rows, plan, plan.count())
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns. Texts are not shuffled."""
    _, plan = mix_plan(docs, weights, share, most)
    n = plan.count()
    # the plan's columns are named for no column of docs
    name = "_plan"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    key = F.struct(docs["source"].isNull(), F.coalesce(docs["source"].cast("string"), F.lit("")))
    plan = plan.select(F.struct(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("of"), "full", "left", "at", "nearer").alias(name))
    both = docs.join(F.broadcast(plan) if n <= BROADCAST_SOURCES else plan, key == F.col(f"{name}.of"))
    copies = _copies(_digest(docs["doc_id"]), f"{name}.").cast("int")
    return both.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies)).alias(name)).drop(name)
