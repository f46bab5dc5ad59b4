"""Statistics as aggregates and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def t_stat(x: str | Column, least: int = 5) -> Column:
    """mean / (sample deviation / sqrt(n)); null below `least` or without spread."""
    x = F.col(x) if isinstance(x, str) else x
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= least) & (sd > 0), F.avg(x) / (sd / F.sqrt(F.count(x).cast("double"))))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7 (Spark has no erf)."""
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)  # fixed values of the formula
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + F.lit(c)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal statistic."""
    return F.lit(1.0) - erf(F.abs(z) / math.sqrt(2.0))


def welch(df: DataFrame, by: list[str], side: str, value: str, ddof: int = 1, least: int = 2) -> DataFrame:
    """Per group: Welch's t, Satterthwaite degrees of freedom and the smallest effect of 80 % power between side
    true and side false. ddof 1 is sample, 0 population variance; null with fewer than `least` on a side."""
    var = F.var_samp if ddof else F.var_pop
    pick = lambda v, s: F.when(F.col(side) == F.lit(s), F.col(v))
    g = df.groupBy(*by).agg(
        F.count(pick(value, True)).alias("n1"), F.count(pick(value, False)).alias("n0"),
        F.avg(pick(value, True)).alias("m1"), F.avg(pick(value, False)).alias("m0"),
        var(pick(value, True)).alias("v1"), var(pick(value, False)).alias("v0"),
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    se = F.sqrt(a + b)
    ok = (F.col("n1") >= least) & (F.col("n0") >= least) & (se > 0)
    return g.withColumns({
        "diff": F.col("m1") - F.col("m0"),
        "t": F.when(ok, (F.col("m1") - F.col("m0")) / se),
        "df": F.when(ok, F.pow(a + b, F.lit(2.0)) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))),
        "mde": F.when(ok, F.lit(1.959963984540054 + 0.8416212335729143) * se),
    })


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """0-based average ranks with ties."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(out, (F.rank().over(w) - 1).cast("double") + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def ordered_sum(value: str, *order: str) -> Column:
    """Aggregate: the sum of a group's doubles added up one by one in an order; null without any. A plain sum adds in the
    order in which tasks and shuffles deliver, so equal amounts differ in the last bit from group to group and from run
    to run. For groups that fit a row."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("double").alias("_v")))))
    return F.when(F.count(value) > 0, F.aggregate(rows, F.lit(0.0), lambda total, r: total + r["_v"]))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Per group: Spearman's rho, its t and n over rows with both values; null below `least` or without spread."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(both, by, x, "_rx"), by, y, "_ry")
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"), F.covar_pop("_rx", "_ry").alias("_c"))
    rho = F.when((F.col("n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_c") / (F.col("_sx") * F.col("_sy")))
    g = g.withColumn("rho", rho).drop("_sx", "_sy", "_c")
    return g.withColumn("t", F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share k of n."""
    p, nn = k / n, n.cast("double")
    centre = (p + F.lit(z * z) / (2 * nn)) / (1 + F.lit(z * z) / nn)
    half = F.lit(z) * F.sqrt(p * (1 - p) / nn + F.lit(z * z) / (4 * nn * nn)) / (1 + F.lit(z * z) / nn)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when(se > 0, (k1 / n1 - k2 / n2) / se)


def sign_test_p(k: Column, n: Column) -> Column:
    """Exact one-sided P(X >= k) of n fair coins: one pass over 0..n, each log term from the one before by the ratio of
    neighbouring binomials."""
    start = F.struct((-n * F.lit(math.log(2.0))).alias("term"), F.when(k <= 0, F.exp(-n * F.lit(math.log(2.0)))).otherwise(0.0).alias("sum"))

    def step(a, i):
        term = a["term"] + F.ln((n - i + 1).cast("double") / i)
        return F.struct(term.alias("term"), (a["sum"] + F.when(i >= k, F.exp(term)).otherwise(0.0)).alias("sum"))

    return F.when(n <= 0, F.when(k <= 0, 1.0).otherwise(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), start, step, lambda a: a["sum"]))


def fisher_z_diff(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    """z of the difference of two correlations."""
    return F.when((n1 > 3) & (n2 > 3) & (F.abs(r1) < 1) & (F.abs(r2) < 1), (F.atanh(r1) - F.atanh(r2)) / F.sqrt(F.lit(1.0) / (n1 - 3) + F.lit(1.0) / (n2 - 3)))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, name: str, alpha: float = 0.05, untested: bool = False) -> DataFrame:
    """Each p against its own threshold alpha * rank / m; there is no step-up over larger ranks. Rows without a p are left
    out; with `untested` they rank last, count in m and neither pass nor fail. Ranks come from ranges, so a family of any
    size is spread over tasks."""
    from decisa.operators.ranks import numbered

    family = df if untested else df.filter(F.col(p).isNotNull())
    ranked = numbered(family, by, [F.asc_nulls_last(p), F.asc_nulls_last(name)], "rank", "m").withColumn("rank", F.col("rank").cast("int"))
    ranked = ranked.withColumn("threshold", F.lit(alpha) * F.col("rank") / F.col("m"))
    return ranked.withColumn("passes", F.col(p) <= F.col("threshold"))


def rounded_rank_quantile(values: Column, q: float) -> Column:
    """sorted[round half even (q * (n - 1))] of an array; ranks.quantile_rows() does it for the rows of a group."""
    s = F.array_sort(values)
    return F.get(s, F.bround(F.lit(q) * (F.size(s) - 1)).cast("int"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Cohen's kappa of two labels; null where chance agreement is 1 (a single category)."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("v")), F.struct(F.lit(2).alias("side"), F.col("b").alias("v")))).alias("s"), "n")
    margins = sides.groupBy("s.v").agg((F.coalesce(F.sum(F.when(F.col("s.side") == 1, F.col("n"))), F.lit(0)) * F.coalesce(F.sum(F.when(F.col("s.side") == 2, F.col("n"))), F.lit(0))).alias("p"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = margins.agg(F.sum("p").alias("p"))
    out = total.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("po"), (F.col("p") / (F.col("n") * F.col("n"))).alias("pe"))
    return out.withColumn("kappa", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def drawdown(df: DataFrame, by: str, time: str, value: str, seed: float | None, out: str) -> DataFrame:
    """Running peak minus value; the peak starts at seed, or at the first value."""
    w = Window.partitionBy(by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(w)
    return df.withColumn(out, (peak if seed is None else F.greatest(peak, F.lit(seed))) - F.col(value))


def sharpe(x: str, least: int = 5, year: float = 365.0) -> Column:
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= least) & (sd > 0), F.avg(x) / sd * math.sqrt(year))


def ridge_grams(df: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """Per group the normal equations of rows without nulls: n, sums and cross products as columns g_i_j (feature 0 is
    the intercept, the last one the target). Everything a ridge fit needs, in one aggregate."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    fine = df.dropna(subset=[*features, target])
    return fine.groupBy(*by).agg(*[F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))])


def ridge_solve(row, d: int, lam: float):
    """Coefficients (intercept first, not penalised) from one row of ridge_grams with d features."""
    import numpy as np

    g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(d + 2)] for i in range(d + 2)], float)
    a = g[: d + 1, : d + 1] + lam * np.diag([0.0] + [1.0] * d)
    return np.linalg.solve(a, g[: d + 1, d + 1])
