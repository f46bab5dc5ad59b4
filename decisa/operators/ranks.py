"""Places in large groups without one task a group: rows are dealt by range, numbered there, and offset by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.session import materialize

#: Counts (a row for each range and group) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def in_ranges(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """df written in ranges of (by, order), with the number of its range as _range: ranges in order are df in order."""
    cut = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    return materialize(cut, "ranges")


def numbered(df: DataFrame, by: list[str], order: list[Column | str], place: str = "place", total: str | None = None) -> DataFrame:
    """df with its place (from 1) in the order of its group, and the group's number of rows where `total` names it.

    A window by a few groups sorts each of them in one task. Here the table is written in ranges of (by, order); a
    row's place is its place within its range and group after all rows of the ranges before. `order` must tell rows
    apart, or equal ones are numbered in any order. Null keys are a group; an empty table stays empty.
    """
    cut = in_ranges(df, by, order)
    counts = cut.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_rows"))
    groups = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_total": F.sum("_rows").over(Window.partitionBy(*groups))})
    counts = materialize(counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_of_{c}") for c in by], "_before", "_total"), "range-counts")
    small = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    out = cut.withColumn("_inside", inside).join(small, same)
    named = [(F.col("_before") + F.col("_inside")).alias(place), *([F.col("_total").alias(total)] if total else [])]
    return out.select(*df.columns, *named)


def quantile_rows(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group of non-null values, for each name of `shares`: the interpolated quantile as `name`, and the value at the
    half-even rounded rank as `name_rounded`; exact, from places instead of a list of the group's values."""
    rows = numbered(df.filter(F.col(value).isNotNull()).select(*by, value), by, [F.col(value)], "_k", "_n")
    k, out = F.col("_k") - 1, []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_n") - 1)
        low, high, near = (F.max(F.when(k == f(at), F.col(value))) for f in (F.floor, F.ceil, F.bround))
        part = F.max(at - F.floor(at))
        out += [(low + (high - low) * part).alias(name), near.alias(f"{name}_rounded")]
    return rows.groupBy(*by).agg(*out)


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of value in its group, equal values sharing their average rank; rows with a null value go."""
    rows = numbered(df.filter(F.col(value).isNotNull()), by, [F.col(value)], "_place")
    shared = rows.groupBy(*by, F.col(value).alias("_v")).agg(((F.min("_place") + F.max("_place")) / 2).alias(out))
    same = F.col(f"r.{value}") == F.col("s._v")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return rows.alias("r").join(shared.alias("s"), same).select(*[F.col(f"r.{c}") for c in df.columns], F.col(f"s.{out}"))
