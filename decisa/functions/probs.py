"""Scores of predicted distributions: likelihood, Brier, calibration errors, curves and divergences.

A scored row has probs (map label -> probability) and a label; a binary row has p and y. Invalid rows (a probability
that is null, outside [0, 1] or a sum off 1 by more than the tolerance) are counted and left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.ranks import in_ranges, numbered


def valid_distribution(probs: Column, tolerance: float = 1e-5) -> Column:
    v = F.map_values(probs)
    ok = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce((x >= 0) & (x <= 1) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(ok & (F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) - 1) <= tolerance), F.lit(False))


def argmax_first(labels: Column, p: Column) -> Column:
    """The first label of the largest probability."""
    return F.get(labels, F.array_position(p, F.array_max(p)).cast("int") - 1)


def argmax_largest_key(probs: Column) -> Column:
    """The largest label of the largest probability."""
    return F.array_max(F.transform(F.map_entries(probs), lambda e: F.struct(e["value"], e["key"])))["key"]


def with_scores(df: DataFrame, probs: str, label: str, floor: float = 1e-30) -> DataFrame:
    """df with predicted, confidence, correct, nll (probability floored) and the multiclass Brier score."""
    p = F.coalesce(F.col(probs)[F.col(label)], F.lit(0.0))
    top = F.array_max(F.map_values(probs))
    sq = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda a, e: a + F.pow(e["value"] - F.when(e["key"] == F.col(label), 1.0).otherwise(0.0), F.lit(2.0)))
    keys = F.array_sort(F.map_keys(probs))
    first = argmax_first(keys, F.transform(keys, lambda k: F.col(probs)[k]))
    return df.withColumns({"predicted": first, "confidence": top, "correct": first == F.col(label), "nll": -F.ln(F.greatest(p, F.lit(floor))), "brier": sq})


def binned(x: Column, bins: int) -> Column:
    """Equal-width bin of [0, 1] from 0; 1 is in the last."""
    return F.least(F.lit(bins - 1), F.floor(x * bins)).cast("int")


def ece(df: DataFrame, by: list[str], confidence: str, hit: str, bins: int = 10) -> DataFrame:
    """Expected and largest calibration error over equal-width bins, per group."""
    b = df.groupBy(*by, binned(F.col(confidence), bins).alias("_bin")).agg(F.count("*").alias("_n"), F.abs(F.avg(confidence) - F.avg(F.col(hit).cast("double"))).alias("_gap"))
    return b.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"), F.max("_gap").alias("mce"))


def adaptive_ece(df: DataFrame, by: list[str], p: str, y: str, key: str, bins: int = 10) -> DataFrame:
    """Calibration error over equal-count slices: slice i is rows [i*n//bins, (i+1)*n//bins) of the order (p, key)."""
    r = numbered(df.select(*by, p, y, key), by, [F.col(p), F.col(key)], "_k", "_n").withColumn("_k", F.col("_k") - 1)
    # the slice of row k is the largest i with i*n//bins <= k
    r = r.withColumn("_i", F.floor(((F.col("_k") + 1) * bins - 1) / F.col("_n")).cast("int"))
    b = r.groupBy(*by, "_i").agg(F.count("*").alias("_c"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("_gap"))
    return b.groupBy(*by).agg((F.sum(F.col("_c") * F.col("_gap")) / F.sum("_c")).alias("adaptive_ece"), F.max("_gap").alias("adaptive_mce"))


def confusion(df: DataFrame, by: list[str], p: str, y: str, tau: float) -> DataFrame:
    """tp, fp, fn, tn, accuracy, recall and precision at a threshold; null where nothing is counted below the line."""
    hit, pos = F.col(p) >= tau, F.col(y) == 1
    g = df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", hit & pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tn", ~hit & ~pos))])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.withColumns({"accuracy": F.try_divide(F.col("tp") + F.col("tn"), n), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp"))})


def divergence(df: DataFrame, q: str, p: str, floor: float = 1e-12) -> DataFrame:
    """df with the total variation, KL (not below 0), cross entropy and squared error of q against the target p."""
    pairs = F.map_values(F.map_zip_with(F.col(p), F.col(q), lambda k, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("p"), F.coalesce(b, F.lit(0.0)).alias("q"))))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, e: s + f(e["p"], F.greatest(e["q"], F.lit(floor)), e["q"]))
    return df.withColumns({
        "tv": total(lambda a, b, raw: F.abs(a - raw)) / 2,
        "kl": F.greatest(F.lit(0.0), total(lambda a, b, raw: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0))),
        "ce": total(lambda a, b, raw: F.when(a > 0, -a * F.ln(b)).otherwise(0.0)),
        "se": total(lambda a, b, raw: (a - raw) * (a - raw)),
    })


def coverage_risk(df: DataFrame, by: list[str], confidence: str, correct: str, steps: int = 100) -> DataFrame:
    """Per group and threshold t = i/steps: rows with confidence >= t, their coverage and accuracy (null without any).

    Rows are counted once by the largest threshold they reach; running sums over the thresholds do the rest."""
    reach = F.floor(F.col(confidence) * steps + 1e-9).cast("int")
    hist = df.groupBy(*by, reach.alias("_i")).agg(F.count("*").alias("_n"), F.sum(F.col(correct).cast("long")).alias("_c"))
    grid = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i")) if by else df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("_i"))
    full = grid.join(hist, [*by, "_i"], "left").fillna(0, ["_n", "_c"])
    up = Window.partitionBy(*by).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"answered": F.sum("_n").over(up), "right": F.sum("_c").over(up)})
    total = F.max("answered").over(Window.partitionBy(*by))
    return full.select(*by, (F.col("_i") / F.lit(steps)).alias("threshold"), "answered", (F.col("answered") / total).alias("coverage"), F.try_divide("right", "answered").alias("accuracy"))


def operating_point(curve: DataFrame, by: list[str], target: float) -> DataFrame:
    """The feasible threshold of most (coverage, accuracy, threshold), else the most accurate one; reached says which."""
    ok = F.coalesce(F.col("accuracy") >= target, F.lit(False))
    best = F.max(F.when(ok, F.struct("coverage", "accuracy", "threshold")))
    other = F.max(F.when(F.col("accuracy").isNotNull(), F.struct("accuracy", "coverage", "threshold")))
    g = curve.groupBy(*by).agg(best.alias("_b"), other.alias("_o"))
    return g.select(*by, F.col("_b").isNotNull().alias("reached"), *[F.coalesce(F.col(f"_b.{c}"), F.col(f"_o.{c}")).alias(c) for c in ("threshold", "coverage", "accuracy")])


def retrieval(df: DataFrame, query: str, doc: str, p: str, relevant: str) -> DataFrame:
    """One row: Recall@1, Recall@3 and MRR over queries with a relevant document; ranks by (-p, doc)."""
    w = Window.partitionBy(query).orderBy(F.desc(p), doc)
    r = df.withColumn("_r", F.row_number().over(w)).groupBy(query).agg(F.min(F.when(F.col(relevant), F.col("_r"))).alias("_first"), F.count_if(F.col(relevant)).alias("_rel"), F.count_if(F.col(relevant) & (F.col("_r") <= 3)).alias("_in3"), F.count_if(F.col(relevant) & (F.col("_r") <= 1)).alias("_in1"))
    r = r.filter("_rel > 0")
    return r.agg(F.count("*").alias("queries"), F.avg(F.col("_in1") / F.col("_rel")).alias("recall_1"), F.avg(F.col("_in3") / F.col("_rel")).alias("recall_3"), F.avg(F.lit(1.0) / F.col("_first")).alias("mrr"))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def logit(p: Column, eps: float = 1e-7) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fit_temperature(df: DataFrame, p: str, y: str, low: float = 0.05, high: float = 20.0, grid: int = 41, rounds: int = 3, eps: float = 1e-7) -> float:
    """The temperature of least NLL on binary rows: each round is one aggregate over a grid of candidates (log spaced),
    then the grid closes in around the best."""
    import math

    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        ts = [math.exp(a + (b - a) * i / (grid - 1)) for i in range(grid)]
        z = logit(F.col(p), eps)
        loss = [F.avg(F.ln(1 + F.exp(F.when(F.col(y) == 1, -z).otherwise(z) / F.lit(t)))).alias(f"l{i}") for i, t in enumerate(ts)]
        row = df.agg(*loss).first()
        k = min(range(grid), key=lambda i: row[i] if row[i] is not None else float("inf"))
        step = (b - a) / (grid - 1)
        a, b = math.log(ts[k]) - step, math.log(ts[k]) + step
    return ts[k]


def fit_platt(df: DataFrame, p: str, y: str, rounds: int = 12, eps: float = 1e-7) -> tuple[float, float]:
    """(slope, intercept) of logistic regression on the logit: Newton steps, gradient and Hessian from one aggregate each."""
    a, b = 1.0, 0.0
    rows = df.select(logit(F.col(p), eps).alias("z"), F.col(y).cast("double").alias("y")).persist()
    try:
        for _ in range(rounds):
            q = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
            w, r = q * (1 - q), q - F.col("y")
            g = rows.agg(F.sum(r * F.col("z")), F.sum(r), F.sum(w * F.col("z") * F.col("z")), F.sum(w * F.col("z")), F.sum(w)).first()
            if g[0] is None:
                return 1.0, 0.0
            det = g[2] * g[4] - g[3] * g[3]
            if abs(det) < 1e-12:
                break
            da, db = (g[4] * g[0] - g[3] * g[1]) / det, (g[2] * g[1] - g[3] * g[0]) / det
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-10:
                break
    finally:
        rows.unpersist()
    return a, b


def pava(df: DataFrame, by: str, p: str, y: str) -> DataFrame:
    """Isotonic knots (by, x_low, x_high, value, weight) per domain: equal p are pooled in an aggregate first, then those
    of each range of p while they don't rise, and last the ranges' blocks; pooling in parts gives the same blocks."""
    import pandas as pd

    pooled = df.groupBy(by, p).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("w"))
    pooled = in_ranges(pooled.select(by, F.col(p).alias("x_low"), F.col(p).alias("x_high"), "s", F.col("w").cast("double").alias("w")), [by], [F.col("x_low")])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x_low")
        blocks: list[list[float]] = []  # sum, weight, first x, last x
        for low, high, s, w in zip(rows["x_low"], rows["x_high"], rows["s"], rows["w"], strict=True):
            blocks.append([s, w, low, high])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s2, w2, _, last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2], last]
        return pd.DataFrame({by: rows[by].iloc[0], "x_low": [b[2] for b in blocks], "x_high": [b[3] for b in blocks], "s": [b[0] for b in blocks], "w": [b[1] for b in blocks]})

    schema = f"{by} {dict(df.dtypes)[by]}, x_low double, x_high double, s double, w double"
    knots = pooled.groupBy("_range", by).applyInPandas(run, schema).groupBy(by).applyInPandas(run, schema)
    return knots.select(by, "x_low", "x_high", (F.col("s") / F.col("w")).alias("value"), F.col("w").cast("long").alias("weight"))


def apply_isotonic(df: DataFrame, knots: DataFrame, by: str, p: str, out: str) -> DataFrame:
    """df with its calibrated probability: a knot's value inside its range, a straight line between two knots, the
    nearest end outside; null for a domain without knots. A domain's knots are one array: monotone steps, few."""
    steps = knots.groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct("x_low", "x_high", "value"))).alias("_knots"))
    x, low = F.col(p), F.filter("_knots", lambda k: k["x_low"] <= F.col(p))
    a, b = F.element_at(low, -1), F.get(F.col("_knots"), F.size(low))
    line = a["value"] + (b["value"] - a["value"]) * (x - a["x_high"]) / (b["x_low"] - a["x_high"])
    value = F.when(F.size(low) == 0, b["value"]).when((x <= a["x_high"]) | b.isNull(), a["value"]).otherwise(line)
    return df.join(steps, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn(out, F.when(F.col("_knots").isNotNull(), value)).drop("_by", "_knots")
