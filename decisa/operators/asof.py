"""As-of joins by union and a running last value: one shuffle on the key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], *, strict: bool = False, forward: bool = False, tie: list[str] | None = None, bucket: int | None = None) -> DataFrame:
    """left with the columns `take` of the nearest right row of the same key; null without one.

    Backward: the latest right row at or before left_time (before it, if strict). Forward: the earliest at or after
    (after). Of right rows at one time the last by `tie` counts. bucket (a span of numeric time) splits a key's rows
    over tasks: each bucket keeps a running value, and what earlier buckets end with is carried in from one row a
    bucket, so a single hot key doesn't sort in one task.
    """
    tie = tie or []
    facts = right.select(*by, F.col(right_time).alias("_t"), F.struct(*[F.col(c).alias(c) for c in take]).alias("_fact"), F.struct(*tie, F.lit(0).alias("_none")).alias("_tie"))
    asks = left.select(*[F.col(c) for c in by], F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"))
    both = facts.withColumn("_side", F.lit(1 if strict else 0)).unionByName(asks.withColumn("_side", F.lit(0 if strict else 1)), allowMissingColumns=True)
    time, side = (F.desc("_t"), F.asc("_side")) if forward else (F.asc("_t"), F.asc("_side"))
    order = (time, side, F.asc_nulls_first("_tie"))
    if bucket is None:
        run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("_got", F.last("_fact", ignorenulls=True).over(run))
    else:
        both = both.withColumn("_bucket", F.floor(F.col("_t") / bucket))
        run = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rank = F.struct("_t", "_tie") if not forward else F.struct((-F.col("_t")).alias("_t"), "_tie")
        ends = both.filter("_fact is not null").groupBy(*by, "_bucket").agg(F.max_by("_fact", rank).alias("_end"))
        ends = both.select(*by, "_bucket").distinct().join(ends, [*by, "_bucket"], "left")
        step = F.desc("_bucket") if forward else F.asc("_bucket")
        before = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        got = both.withColumn("_own", F.last("_fact", ignorenulls=True).over(run)).join(carried, [*by, "_bucket"]).withColumn("_got", F.coalesce("_own", "_carried"))
    return got.filter("_row is not null").select("_row.*", *[F.col(f"_got.{c}").alias(c) for c in take])


def carry_forward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, tie: list[str] | None = None) -> DataFrame:
    """left with the last value at or before its time, flagged stale when it isn't of that very time."""
    out = asof_join(left, right.withColumn("as_of", F.col(right_time)), by, left_time, right_time, [value, "as_of"], tie=tie)
    return out.withColumn("stale", F.col("as_of").isNull() | (F.col("as_of") != F.col(left_time)))


def availability_faults(df: DataFrame, decision: str, available: str) -> DataFrame:
    """One row (used, violations): rows that use a value, and those whose value was there only after the decision."""
    return df.agg(F.count(available).alias("used"), F.count_if(F.col(available) > F.col(decision)).alias("violations"))
