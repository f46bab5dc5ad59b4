"""Walk-forward fits on panels: every fit is the solution of summed normal equations, of which a day has one row.

Sums of days give any training window, so lambdas, folds and refit policies need one pass over the data; the driver
solves systems of a few columns. What it holds is one row a day, features squared numbers wide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisa.functions.stats import ridge_grams
from decisa.operators.ranks import average_ranks


def _grams(df: DataFrame, day: str, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """(days, a matrix for each): the full normal equations with intercept and target, by day in order."""
    rows = ridge_grams(df, [day], features, target).orderBy(day).collect()
    k = len(features) + 2
    mats = np.array([[[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)] for r in rows], float).reshape(-1, k, k)
    return np.array([r[day] for r in rows]), mats


def _solve(g: np.ndarray, lam: float) -> np.ndarray:
    d = len(g) - 2
    return np.linalg.solve(g[: d + 1, : d + 1] + lam * np.diag([1e-9] + [1.0] * d) + 1e-9 * np.eye(d + 1), g[: d + 1, d + 1])


def _sse(g: np.ndarray, b: np.ndarray) -> float:
    """Sum of squared errors of coefficients on the rows that a matrix sums."""
    d = len(g) - 2
    return float(g[d + 1, d + 1] - 2 * b @ g[: d + 1, d + 1] + b @ g[: d + 1, : d + 1] @ b)


def select_lambda(df: DataFrame, day: str, features: list[str], target: str, lambdas: list[float], chunks: int = 5, embargo: int = 2) -> DataFrame:
    """(lam, mse, chosen): days in contiguous chunks; each chunk but the first is predicted from those before it, less
    an embargo of days; the mean of the chunks' errors decides, ties go to the smaller lambda."""
    days, g = _grams(df, day, features, target)
    parts = np.array_split(np.arange(len(days)), chunks)
    out = []
    for lam in lambdas:
        errors = []
        for part in parts[1:]:
            train = g[days < days[part[0]] - embargo].sum(axis=0) if len(part) else None
            if train is None or train[0, 0] <= len(features) + 2:
                continue
            test = g[part].sum(axis=0)
            errors.append(_sse(test, _solve(train, lam)) / test[0, 0])
        out.append((float(lam), float(np.mean(errors)) if errors else None))
    best = min((m, lam) for lam, m in out if m is not None)[1] if any(m is not None for _, m in out) else None
    return df.sparkSession.createDataFrame([(lam, m, lam == best) for lam, m in out], "lam double, mse double, chosen boolean")


def _predicted(df: DataFrame, features: list[str], b: np.ndarray):
    p = F.lit(float(b[0]))
    for c, x in zip(features, b[1:], strict=True):
        p = p + F.lit(float(x)) * F.col(c)
    return df.withColumn("pred", p)


def evaluate_fold(df: DataFrame, day: str, asset: str, features: list[str], target: str, cut: int, lam: float) -> DataFrame:
    """One row: error against the training mean's, Spearman, top-decile spread and sign accuracy on days from cut on."""
    days, g = _grams(df, day, features, target)
    train = g[days < cut].sum(axis=0)
    mean = train[0, -1] / train[0, 0]
    test = _predicted(df.filter(F.col(day) >= cut).dropna(subset=[*features, target]), features, _solve(train, lam))
    q = test.agg(F.percentile("pred", 0.9).alias("q"))
    y, p = F.col(target), F.col("pred")
    got = test.join(F.broadcast(q)).agg(
        F.count("*").alias("n"), (F.avg((y - p) * (y - p)) / F.avg((y - F.lit(float(mean))) * (y - F.lit(float(mean))))).alias("mse_ratio"),
        (F.avg(F.when(p >= F.col("q"), y)) - F.avg(y)).alias("top_spread"), F.avg(((y > mean) == (p > mean)).cast("double")).alias("sign_accuracy"),
    )
    ranked = average_ranks(average_ranks(test.select("pred", target), [], "pred", "_p"), [], target, "_t")
    return got.join(F.broadcast(ranked.agg(F.corr("_p", "_t").alias("rho"))))


def refit_policies(df: DataFrame, day: str, features: list[str], target: str, start: int, every: int, window: int, lam: float) -> DataFrame:
    """(policy, n, mse, drift): frozen at start, expanding or rolling refits each `every` days, scored on the days from
    start on; drift is the mean absolute change of coefficients between refits."""
    days, g = _grams(df, day, features, target)
    out = []
    for policy in ("frozen", "expanding", "rolling"):
        sse = n = 0.0
        drift, last = [], None
        for t in range(start, int(days.max()) + 1, every):
            edge = start if policy == "frozen" else t
            use = (days < edge) & ((days >= edge - window) if policy == "rolling" else True)
            b = _solve(g[use].sum(axis=0), lam)
            test = g[(days >= t) & (days < t + every)].sum(axis=0)
            sse, n = sse + _sse(test, b), n + test[0, 0]
            if last is not None:
                drift.append(float(np.abs(b - last).mean()))
            last = b
        out.append((policy, int(n), float(sse / n) if n else None, float(np.mean(drift)) if drift else 0.0))
    return df.sparkSession.createDataFrame(out, "policy string, n long, mse double, drift double")


def scored_ledger(df: DataFrame, day: str, asset: str, features: list[str], target: str, start: int, lam: float) -> DataFrame:
    """(asset, day, pred, realized, hit): each day scored by the fit on all days before it, resolved by its target.

    Coefficients are one row a day, joined to the panel by day."""
    days, g = _grams(df, day, features, target)
    fits = [(int(t), [float(x) for x in _solve(g[days < t].sum(axis=0), lam)]) for t in days if t >= start and (days < t).any()]
    b = df.sparkSession.createDataFrame(fits, "_day long, _b array<double>")
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    rows = df.join(F.broadcast(b), F.col(day) == F.col("_day")).withColumn("pred", F.aggregate(F.zip_with(x, "_b", lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v))
    return rows.select(asset, F.col(day).alias("day"), "pred", F.col(target).alias("realized"), (F.abs(F.col("pred") - F.col(target)) <= 1).alias("hit"))


def fit_logistic(df: DataFrame, features: list[str], target: str, steps: int, rate: float, l2: float = 1e-3, objective: str = "ce") -> DataFrame:
    """(name, coefficient): gradient descent of the cross entropy (ce) or the squared error (brier) on standardised
    features; a step is one aggregate of the gradient."""
    rows = df.dropna(subset=[*features, target])
    m = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features], F.count("*").alias("n")).first()
    z = [F.lit(1.0), *[(F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"] or 1.0) for c in features]]
    rows = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], F.col(target).cast("double").alias("y")).persist()
    b = np.zeros(len(z))
    try:
        for _ in range(steps):
            q = F.lit(1.0) / (1 + F.exp(-sum((F.lit(float(x)) * F.col(f"z{i}") for i, x in enumerate(b)), F.lit(0.0))))
            slope = (q - F.col("y")) * (2 * q * (1 - q) if objective == "brier" else 1)
            g = rows.agg(*[F.avg(slope * F.col(f"z{i}")) for i in range(len(z))]).first()
            b = b - rate * (np.array([x or 0.0 for x in g]) + l2 * np.concatenate(([0.0], b[1:])))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(list(zip(["intercept", *features], map(float, b), strict=True)), "name string, coefficient double")


def fit_stumps(df: DataFrame, features: list[str], target: str, rounds: int, rate: float, bins: int = 16, l2: float = 1.0) -> DataFrame:
    """(round, feature, threshold, left, right, gain): boosted stumps on the logistic loss. Candidate thresholds are each
    feature's approximate quantiles; a round sums gradient and curvature once by feature and bin and takes the split of
    most gain (ties: first feature, smallest threshold), a leaf being its Newton step times the rate. Rows equal to a
    threshold go left. The driver sees a row for each feature and bin."""
    rows = df.dropna(subset=[*features, target]).select(*[F.col(f).cast("double") for f in features], F.col(target).cast("double").alias("_y"))
    cuts = dict(zip(features, rows.approxQuantile(features, [i / bins for i in range(1, bins)], 0.001), strict=True))
    cuts = {f: sorted(set(c)) for f, c in cuts.items()}
    bin_of = lambda f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0))
    rows = rows.select("_y", *[bin_of(f).alias(f) for f in features]).persist()
    score, out = F.lit(0.0), []
    try:
        for k in range(rounds):
            q = F.lit(1.0) / (1 + F.exp(-score))
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(features)])).alias("c")
            got = rows.select((q - F.col("_y")).alias("g"), (q * (1 - q)).alias("h"), each).groupBy("c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            best = None
            for i, f in enumerate(features):
                g, h = np.zeros(len(cuts[f]) + 1), np.zeros(len(cuts[f]) + 1)
                for r in got:
                    if r["f"] == i:
                        g[r["b"]], h[r["b"]] = r["g"], r["h"]
                for j in range(len(cuts[f])):
                    gl, hl, gr, hr = g[: j + 1].sum(), h[: j + 1].sum(), g[j + 1 :].sum(), h[j + 1 :].sum()
                    gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - (gl + gr) ** 2 / (hl + hr + l2)
                    if best is None or gain > best[-1] + 1e-12:
                        best = (f, j, cuts[f][j], -rate * gl / (hl + l2), -rate * gr / (hr + l2), gain)
            if best is None:
                break
            f, j, cut, left, right, gain = best
            score = score + F.when(F.col(f) <= j, left).otherwise(right)
            out.append((k, f, float(cut), float(left), float(right), float(gain)))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "round int, feature string, threshold double, left double, right double, gain double")
