"""Bootstraps and placebo shuffles with hashed draws, so every run gives the same numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.ranks import numbered


def cluster_bootstrap(df: DataFrame, group: str, value: Column, samples: int, seed: str) -> DataFrame:
    """(sample, mean): each sample draws as many groups as there are, with replacement, and pools their rows.

    Groups are summed first; a sample is then a weighted sum over groups, the weights are how often its draws hit
    each. Draw j of sample b is sha256("seed|b|j") modulo the number of groups, groups in order."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    g = numbered(g, [], [F.col(group)], "i").withColumn("i", F.col("i") - 1)
    m = g.count()
    draws = df.sparkSession.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("sample").cast("string"), F.col("j").cast("string")), 256), 1, 8), 16, 10).cast("long")
    hits = draws.select("sample", (h % m).alias("i")).groupBy("sample", "i").agg(F.count("*").alias("k"))
    return hits.join(g, "i").groupBy("sample").agg((F.sum(F.col("k") * F.col("s")) / F.sum(F.col("k") * F.col("n"))).alias("mean"))


def paired_bootstrap(df: DataFrame, group: str, a: str, b: str, samples: int, seed: str) -> DataFrame:
    """(sample, mean): the same over paired differences b - a, both arms of a group drawn together."""
    return cluster_bootstrap(df, group, F.col(b) - F.col(a), samples, seed)


def _draw(parts: list[Column | str], of: str) -> Column:
    """A number below the column `of` that a hash of the parts draws."""
    h = F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.col(of)


def hierarchical_bootstrap(df: DataFrame, arm: str, seed: str, group: str, value: Column, samples: int, salt: str) -> DataFrame:
    """(sample, arm, mean): each sample draws as many seeds as an arm has, then within each drawn seed as many groups as
    it has, both with replacement; a group's weight is the product of how often it and its seed were drawn.

    Rows of one (arm, seed, group) are summed first. Draws are sha256("salt|sample|arm|j") over the arm's seeds and
    sha256("salt|sample|arm|seed|j") over the seed's groups, both in order; a seed that is drawn twice keeps its draw of
    groups. Rows with a null value, arm, seed or group are left out."""
    g = df.select(F.col(arm).alias("arm"), F.col(seed).alias("seed"), F.col(group).alias("group"), value.alias("v")).dropna()
    g = g.groupBy("arm", "seed", "group").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    g = numbered(g, ["arm", "seed"], [F.col("group")], "i", "groups")
    seeds = numbered(g.select("arm", "seed", "groups").distinct(), ["arm"], [F.col("seed")], "i", "seeds")
    counts = df.sparkSession.range(samples).select(F.col("id").alias("sample"))
    dealt = counts.join(F.broadcast(seeds.select("arm", "seeds").distinct()))  # an arm is a row
    first = dealt.select("sample", "arm", "seeds", F.explode(F.sequence(F.lit(1), F.col("seeds"))).alias("j"))
    first = first.select("sample", "arm", (_draw([F.lit(salt), "sample", "arm", "j"], "seeds") + 1).alias("i")).groupBy("sample", "arm", "i").agg(F.count("*").alias("k"))
    first = first.join(seeds, ["arm", "i"]).select("sample", "arm", "seed", "groups", "k")
    second = first.select("*", F.explode(F.sequence(F.lit(1), F.col("groups"))).alias("j"))
    second = second.select("sample", "arm", "seed", "k", (_draw([F.lit(salt), "sample", "arm", "seed", "j"], "groups") + 1).alias("i"))
    weights = second.groupBy("sample", "arm", "seed", "i").agg((F.count("*") * F.max("k")).alias("w"))
    rows = weights.join(g.drop("groups"), ["arm", "seed", "i"])
    return rows.groupBy("sample", "arm").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))


def contrasts(means: DataFrame, coefficients: dict[str, dict[str, float]], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(contrast, samples, low, high): linear contrasts between arms of (sample, arm, mean), as intervals between samples.

    coefficients names each contrast's factor of each arm, which are equal within a sample. The ends are the samples at
    index floor(share * (number - 1)) and ceil(...) of their order. A sample that lacks one of a contrast's arms doesn't
    count for it. Samples are few, a row each, so a contrast's are one array."""
    rows = [(name, arm, float(factor)) for name, arms in coefficients.items() for arm, factor in arms.items()]
    table = means.sparkSession.createDataFrame(rows, "contrast string, arm string, factor double")
    size = F.create_map(*[F.lit(x) for name, arms in coefficients.items() for x in (name, len(arms))])
    each = means.withColumn("arm", F.col("arm").cast("string")).join(F.broadcast(table), "arm").groupBy("contrast", "sample").agg(F.sum(F.col("factor") * F.col("mean")).alias("value"), F.count("*").alias("arms"))
    each = each.filter(F.col("arms") == size[F.col("contrast")])
    values = F.sort_array(F.collect_list("value"))
    at = lambda k: F.get("v", k.cast("int"))
    g = each.groupBy("contrast").agg(values.alias("v"))
    return g.select("contrast", F.size("v").cast("long").alias("samples"), at(F.floor(low * (F.size("v") - 1))).alias("low"), at(F.ceil(high * (F.size("v") - 1))).alias("high"))


def placebo(df: DataFrame, by: list[str], key: str, value: str, seed: str, out: str) -> DataFrame:
    """df with the values of each group dealt out anew: row k by key gets the value that is k-th by a seeded hash."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in by], F.col(key).cast("string")), 256)
    place = Window.partitionBy(*by).orderBy(key)
    dealt = Window.partitionBy(*by).orderBy("_h", key)
    rows = df.withColumn("_h", h).withColumn("_k", F.row_number().over(place)).withColumn("_d", F.row_number().over(dealt))
    values = rows.select(*by, F.col("_d").alias("_k"), F.col(value).alias(out))
    return rows.drop("_h", "_d").join(values, [*by, "_k"]).drop("_k")
