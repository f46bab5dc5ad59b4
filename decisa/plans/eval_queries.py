"""Evaluation queries on labels with hash-derived probabilities: scores, calibration, curves, agreement, bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisa.functions import probs, stats
from decisa.operators import joins, panel as books, ranks
from decisa.plans.base import SCORED, query, rounded, scored, table


@query(f"""WITH {SCORED}, s AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pl FROM scored)
SELECT split, count(*) AS n, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(-ln(greatest(pl, 1e-30))), 6) AS nll,
round(avg(2 * (1 - pl) * (1 - pl)), 6) AS brier, round(avg(conf), 6) AS confidence FROM s GROUP BY split""")
def multiclass_metrics(spark, sf_dir):
    s = scored(spark, sf_dir).filter(probs.valid_distribution(F.col("probs")))
    s = probs.with_scores(s.drop("correct"), "probs", "label")
    return rounded(s.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("confidence").alias("confidence")))


@query(f"""WITH {SCORED}, a AS (SELECT grp, y, count(*) AS n, avg(correct::INT::DOUBLE) AS acc FROM scored GROUP BY 1, 2), b AS (SELECT grp, avg(acc) AS balanced FROM a GROUP BY grp)
SELECT s.grp, round(avg(conf), 6) AS mean_conf, round(count(*) FILTER (conf >= 0.9) / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (conf >= 0.9 AND NOT correct) AS confident_wrong, round(avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))), 6) AS nll,
round(any_value(balanced), 6) AS balanced, round(quantile_disc(u, 0.5), 6) AS p50, round(quantile_disc(u, 0.95), 6) AS p95 FROM scored s JOIN b USING (grp) GROUP BY s.grp""")
def bundle_scorecard(spark, sf_dir):
    s = scored(spark, sf_dir)
    recall = s.groupBy("grp", "y").agg(F.avg(F.col("correct").cast("double")).alias("acc")).groupBy("grp").agg(F.avg("acc").alias("balanced"))
    g = s.groupBy("grp").agg(
        F.avg("conf").alias("mean_conf"), (F.count_if(F.col("conf") >= 0.9) / F.count("*")).alias("coverage"), F.count_if((F.col("conf") >= 0.9) & ~F.col("correct")).alias("confident_wrong"),
        F.avg(-F.ln(F.greatest(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-12)))).alias("nll"),
        F.expr("percentile_disc(0.5) within group (order by u)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by u)").alias("p95"),
    )
    return rounded(g.join(recall, "grp"))


@query(f"""WITH {SCORED} SELECT grp, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.9), 6) AS q90, round(list_sort(list(p))[CAST(round_even(0.9::DOUBLE * (count(*) - 1), 0) AS INT) + 1], 6) AS rounded90 FROM scored GROUP BY grp""")
def quantile_conventions(spark, sf_dir):
    """Interpolated, and rounded-rank quantiles of one column."""
    g = ranks.quantile_rows(scored(spark, sf_dir), ["grp"], "p", {"q25": 0.25, "q90": 0.9})
    return rounded(g.select("grp", "q25", "q90", F.col("q90_rounded").alias("rounded90")))


def _ece_sql(bins: int, conf: str, hit: str) -> str:
    return f"""WITH {SCORED}, b AS (SELECT split, least({bins - 1}, floor({conf} * {bins})) AS bin, count(*) AS n, abs(avg({conf}) - avg({hit}::INT::DOUBLE)) AS gap FROM scored GROUP BY 1, 2)
SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b GROUP BY split"""


@query(_ece_sql(10, "conf", "correct"))
def ece_top_label_10(spark, sf_dir):
    return rounded(probs.ece(scored(spark, sf_dir), ["split"], "conf", "correct", 10))


@query(_ece_sql(15, "conf", "correct"))
def ece_top_label_15(spark, sf_dir):
    return rounded(probs.ece(scored(spark, sf_dir), ["split"], "conf", "correct", 15))


@query(_ece_sql(15, "p", "(y = 1)"))
def ece_positive_15(spark, sf_dir):
    return rounded(probs.ece(scored(spark, sf_dir).withColumn("hit", F.col("y") == 1), ["split"], "p", "hit", 15))


@query(_ece_sql(10, "p", "(y = 1)"))
def ece_positive_fixed_10(spark, sf_dir):
    return rounded(probs.ece(scored(spark, sf_dir).withColumn("hit", F.col("y") == 1), ["split"], "p", "hit", 10))


@query(f"""WITH {SCORED}, k AS (SELECT split, p, y, row_number() OVER (PARTITION BY split ORDER BY p, id) - 1 AS k, count(*) OVER (PARTITION BY split) AS n FROM scored),
b AS (SELECT split, ((k + 1) * 10 - 1) // n AS i, count(*) AS c, abs(avg(p) - avg(y::DOUBLE)) AS gap FROM k GROUP BY 1, 2)
SELECT split, round(sum(c * gap) / sum(c), 6) AS adaptive_ece, round(max(gap), 6) AS adaptive_mce FROM b GROUP BY split""")
def ece_adaptive_10(spark, sf_dir):
    return rounded(probs.adaptive_ece(scored(spark, sf_dir), ["split"], "p", "y", "id"))


@query(f"""WITH {SCORED}, c AS (SELECT grp, count(*) FILTER (p >= 0.6 AND y = 1) AS tp, count(*) FILTER (p >= 0.6 AND y = 0) AS fp, count(*) FILTER (p < 0.6 AND y = 1) AS fn, count(*) FILTER (p < 0.6 AND y = 0) AS tn FROM scored GROUP BY grp)
SELECT *, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision FROM c""")
def confusion_at_threshold(spark, sf_dir):
    return rounded(probs.confusion(scored(spark, sf_dir), ["grp"], "p", "y", 0.6))


@query(f"""WITH {SCORED}, d AS (SELECT id, p, 0.2::DOUBLE + 0.6::DOUBLE * toxic AS g FROM scored)
SELECT id, round((abs(p - g) + abs((1 - p) - (1 - g))) / 2, 6) AS tv, round(greatest(0, g * ln(g / p) + (1 - g) * ln((1 - g) / (1 - p))), 6) AS kl,
round(-g * ln(p) - (1 - g) * ln(1 - p), 6) AS ce, round((p - g) * (p - g) + ((1 - p) - (1 - g)) * ((1 - p) - (1 - g)), 6) AS se FROM d""")
def distribution_divergence(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("g", F.lit(0.2) + F.lit(0.6) * F.col("toxic"))
    s = s.withColumn("gold", F.create_map(F.lit("1"), F.col("g"), F.lit("0"), 1 - F.col("g")))
    return rounded(probs.divergence(s, "probs", "gold").select("id", "tv", "kl", "ce", "se"))


@query(f"""WITH {SCORED} SELECT split, grp, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((), (split), (split, grp))""")
def group_rollups(spark, sf_dir):
    g = scored(spark, sf_dir).groupingSets([[], [F.col("split")], [F.col("split"), F.col("grp")]], "split", "grp")
    return rounded(g.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")))


CURVE = f"""{SCORED}, t AS (SELECT i, i / 100.0::DOUBLE AS threshold FROM range(101) r(i)), c AS (
  SELECT s.split, t.threshold, count(*) FILTER (floor(conf * 100 + 1e-9) >= i) AS answered, count(*) FILTER (floor(conf * 100 + 1e-9) >= i AND correct) AS rgt, count(*) AS n FROM scored s, t GROUP BY 1, 2
), curve AS (SELECT split, threshold, answered, answered / n::DOUBLE AS coverage, rgt / nullif(answered, 0)::DOUBLE AS accuracy FROM c)"""


@query(f"WITH {CURVE} SELECT split, round(threshold, 6) AS threshold, answered, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM curve")
def coverage_risk_curve(spark, sf_dir):
    return rounded(probs.coverage_risk(scored(spark, sf_dir), ["split"], "conf", "correct"))


@query(f"""WITH {CURVE}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY coalesce(accuracy >= 0.75, false) DESC, CASE WHEN accuracy >= 0.75 THEN coverage ELSE accuracy END DESC NULLS LAST, CASE WHEN accuracy >= 0.75 THEN accuracy ELSE coverage END DESC, threshold DESC) AS k FROM curve)
SELECT split, accuracy >= 0.75 AS reached, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM k WHERE k = 1""")
def operating_point(spark, sf_dir):
    return rounded(probs.operating_point(probs.coverage_risk(scored(spark, sf_dir), ["split"], "conf", "correct"), ["split"], 0.75))


@query(f"WITH {SCORED} SELECT split, count(*) AS errors, array_to_string(list_sort(list(id))[1:20], ',') AS examples FROM scored WHERE NOT correct AND conf >= 0.6 GROUP BY split")
def protected_errors(spark, sf_dir):
    s = scored(spark, sf_dir).filter(~F.col("correct") & (F.col("conf") >= 0.6)).select("split", "id")
    shown = books.top_k(s, ["split"], ["id"], 20).groupBy("split").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("examples"))
    return s.groupBy("split").agg(F.count("*").alias("errors")).join(shown, "split")


@query(f"""WITH {SCORED}, q AS (SELECT id // 10 AS q, id, p, toxic = 1 AS rel, row_number() OVER (PARTITION BY id // 10 ORDER BY p DESC, id) AS r FROM scored), g AS (SELECT q, min(r) FILTER (rel) AS f, count(*) FILTER (rel) AS n, count(*) FILTER (rel AND r <= 3) AS n3, count(*) FILTER (rel AND r <= 1) AS n1 FROM q GROUP BY q HAVING count(*) FILTER (rel) > 0)
SELECT count(*) AS queries, round(avg(n1 / n::DOUBLE), 6) AS recall_1, round(avg(n3 / n::DOUBLE), 6) AS recall_3, round(avg(1.0::DOUBLE / f), 6) AS mrr FROM g""")
def retrieval_metrics(spark, sf_dir):
    s = scored(spark, sf_dir).withColumns({"q": F.floor(F.col("id") / 10), "rel": F.col("toxic") == 1})
    return rounded(probs.retrieval(s, "q", "id", "p", "rel"))


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS same FROM c), m AS (SELECT sum((SELECT coalesce(sum(n), 0) FROM c WHERE a = v) * (SELECT coalesce(sum(n), 0) FROM c WHERE b = v)) AS p FROM (VALUES (0), (1)) x(v))
SELECT CAST(n AS BIGINT) AS n, round(same / n::DOUBLE, 6) AS po, round(p / (n * n)::DOUBLE, 6) AS pe, round((same / n::DOUBLE - p / (n * n)::DOUBLE) / (1 - p / (n * n)::DOUBLE), 6) AS kappa FROM t, m""")
def cohens_kappa(spark, sf_dir):
    return rounded(stats.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("SELECT count(*) AS n, round(corr(quality, toxic), 6) AS phi FROM labels")
def phi_coefficient(spark, sf_dir):
    return rounded(table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.corr(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("phi")))


@query(f"""WITH {SCORED}, g AS (SELECT split, count(*) AS n, count(*) FILTER (correct) AS k, corr(p, y) AS r FROM scored GROUP BY split), x AS (SELECT e.k AS k1, e.n AS n1, f.k AS k2, f.n AS n2, e.r AS r1, f.r AS r2 FROM g e, g f WHERE e.split = 'eval' AND f.split = 'fit')
SELECT round((k1 / n1::DOUBLE - k2 / n2::DOUBLE) / sqrt((k1 + k2) / (n1 + n2)::DOUBLE * (1 - (k1 + k2) / (n1 + n2)::DOUBLE) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 6) AS z, round((atanh(r1) - atanh(r2)) / sqrt(1.0::DOUBLE / (n1 - 3) + 1.0::DOUBLE / (n2 - 3)), 6) AS fisher FROM x""")
def proportion_and_fisher_tests(spark, sf_dir):
    pick = lambda f, s: f(F.when(F.col("split") == s, F.lit(1)))
    of = lambda s: (F.count_if((F.col("split") == s) & F.col("correct")), pick(F.count, s), F.corr(F.when(F.col("split") == s, F.col("p")), F.when(F.col("split") == s, F.col("y").cast("double"))))
    k1, n1, r1 = of("eval")
    k2, n2, r2 = of("fit")
    x = scored(spark, sf_dir).agg(k1.alias("k1"), n1.alias("n1"), r1.alias("r1"), k2.alias("k2"), n2.alias("n2"), r2.alias("r2"))
    return rounded(x.select(stats.two_proportion_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")).alias("z"), stats.fisher_z_diff(F.col("r1"), F.col("n1"), F.col("r2"), F.col("n2")).alias("fisher")))


@query(f"""WITH {SCORED}, b AS (SELECT id, p, least(1.0::DOUBLE, p + 0.2::DOUBLE) AS p2 FROM scored)
SELECT id, (p >= 0.5) <> (p2 >= 0.5) AS flipped, round(2 * abs(p2 - p), 6) AS l1, round(abs(p2 - p), 6) AS max_delta FROM b""")
def perturbation_deltas(spark, sf_dir):
    """Each row against a copy of it whose probability is moved up by 0.2."""
    s = scored(spark, sf_dir).select(F.concat(F.lit("b"), F.col("id")).alias("record_id"), F.lit(None).cast("string").alias("base_id"), "id", "probs", "p")
    q = F.least(F.lit(1.0), F.col("p") + 0.2)
    moved = s.select(F.concat(F.lit("m"), F.col("id")).alias("record_id"), F.col("record_id").alias("base_id"), "id", F.create_map(F.lit("1"), q, F.lit("0"), 1 - q).alias("probs"), "p")
    out = joins.perturbation_delta(s.unionByName(moved))
    return rounded(out.select(F.substring("record_id", 2, 20).cast("long").alias("id"), "flipped", "l1", "max_delta"))


@query(f"""WITH {SCORED}, a AS (SELECT id, y AS label FROM scored WHERE u < 0.7), b AS (SELECT id, (p >= 0.5)::INT AS label FROM scored WHERE u > 0.2 OR toxic = 1)
SELECT id, CASE WHEN b.label IS NULL THEN 'only_a' WHEN a.label IS NULL THEN 'only_b' ELSE 'shared' END AS status, a.label = b.label AS agree FROM a FULL JOIN b USING (id)""")
def rater_overlap(spark, sf_dir):
    """Two raters that each saw a part of the rows, by what these hold, and judge in their own way."""
    s = scored(spark, sf_dir)
    other = s.filter("u > 0.2 or toxic = 1").withColumn("label", (F.col("p") >= 0.5).cast("int").cast("string"))
    return joins.label_overlap(s.filter("u < 0.7"), other, "id", "label").select("id", "status", "agree")


@query(f"""WITH {SCORED}, r AS (SELECT id, p FROM scored WHERE conf < 0.7), q AS (SELECT id FROM scored WHERE u > 0.1) SELECT id, CASE WHEN r.id IS NULL THEN 'missing' WHEN q.id IS NULL THEN 'extra' ELSE 'ok' END AS status FROM r FULL JOIN q USING (id)""")
def prediction_alignment(spark, sf_dir):
    """Predictions and references that each lack some rows, by what these hold."""
    s = scored(spark, sf_dir)
    return joins.align_predictions(s.filter("conf < 0.7"), s.filter("u > 0.1"), ["id"], "p").select("id", "status")


@query(f"""WITH {SCORED}, m AS (SELECT id, p, least(1, p * 1.1::DOUBLE) AS p2 FROM scored) SELECT count(*) AS n, round(avg(p2 - p), 6) AS delta, round(stddev_samp(p2 - p), 6) AS sd FROM m""")
def matched_arms(spark, sf_dir):
    s = scored(spark, sf_dir)
    pairs = joins.matched_pairs(s.select("id", "p"), s.select("id", F.least(F.lit(1.0), F.col("p") * 1.1).alias("p")), ["id"], ["p"])
    d = F.col("other_p") - F.col("base_p")
    return rounded(pairs.agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd")))


@query(f"""WITH {SCORED}, v AS (SELECT id, 'a' AS rater, y AS vote, p AS score FROM scored UNION ALL SELECT id, 'b', (p >= 0.5)::INT, 1 - p FROM scored UNION ALL SELECT id, 'c', toxic, u FROM scored), f AS (SELECT id, vote AS f FROM v WHERE rater = 'a')
SELECT v.id, count(*) AS votes, count(DISTINCT vote) AS labels, count(*) FILTER (vote <> f) AS flips, round(max(score) - min(score), 6) AS spread FROM v JOIN f USING (id) GROUP BY v.id""")
def review_votes(spark, sf_dir):
    s = scored(spark, sf_dir)
    v = s.select("id", F.inline(F.array(*[F.struct(F.lit(r).alias("rater"), x.cast("int").alias("vote"), sc.alias("score")) for r, x, sc in (("a", F.col("y"), F.col("p")), ("b", F.col("p") >= 0.5, 1 - F.col("p")), ("c", F.col("toxic"), F.col("u")))])))
    return rounded(joins.vote_summary(v, "id", "rater", "vote", "score"))


@query(f"""WITH {SCORED} SELECT count(*) AS n, round(avg(least(p, u)), 6) AS consensus, count(*) FILTER (conf >= 0.7) AS fast, round(avg(CASE WHEN conf >= 0.7 THEN p ELSE u END), 6) AS routed FROM scored""")
def cascade_routing(spark, sf_dir):
    """A confident answer stays, else the other scorer's; consensus is the least of the members, null if one is."""
    s = scored(spark, sf_dir)
    consensus = F.when(F.col("p").isNotNull() & F.col("u").isNotNull(), F.least("p", "u"))
    return rounded(s.agg(F.count("*").alias("n"), F.avg(consensus).alias("consensus"), F.count_if(F.col("conf") >= 0.7).alias("fast"), F.avg(F.when(F.col("conf") >= 0.7, F.col("p")).otherwise(F.col("u"))).alias("routed")))


@query(f"""WITH {SCORED}, r AS (SELECT id, grp, (p >= 0.5)::INT AS a, (u >= 0.5)::INT AS b FROM scored) SELECT grp, count(*) AS n, round(avg((a = b)::INT::DOUBLE), 6) AS agreement FROM r GROUP BY grp""")
def seed_agreement(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("same", ((F.col("p") >= 0.5) == (F.col("u") >= 0.5)).cast("double"))
    return rounded(s.groupBy("grp").agg(F.count("*").alias("n"), F.avg("same").alias("agreement")))


BOOT = f"""{SCORED}, g AS (SELECT id % 40 AS c, count(*) AS n, sum(correct::INT) AS k FROM scored GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS m FROM g),
d AS (SELECT r.b, j.j, CAST(('0x' || substring(sha256('boot|' || r.b || '|' || j.j), 1, 8)) AS BIGINT) % (SELECT max(m) FROM o) AS i FROM range(200) r(b), range((SELECT max(m) FROM o)) j(j)),
e AS (SELECT d.b, sum(k) / sum(n)::DOUBLE AS acc FROM d JOIN o USING (i) GROUP BY d.b)"""


@query(f"WITH {BOOT} SELECT count(*) AS samples, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high FROM e")
def cluster_bootstrap(spark, sf_dir):
    """Groups are resampled by hashed draws over their sums, so no row is copied."""
    from decisa.operators.resample import cluster_bootstrap as boot

    s = scored(spark, sf_dir).withColumn("c", F.col("id") % 40)
    means = boot(s, "c", F.col("correct").cast("long"), 200, "boot")
    return rounded(means.agg(F.count("*").alias("samples"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")))


LOGITS = f"""{SCORED}, z AS MATERIALIZED (SELECT id, split, y, ln(greatest(1e-7, least(1 - 1e-7, p)) / (1 - greatest(1e-7, least(1 - 1e-7, p)))) AS z FROM scored)"""


def _temperature_sql(rounds: int = 3, grid: int = 41) -> str:
    parts = ["b0 AS (SELECT ln(0.05::DOUBLE) AS lo, ln(20.0::DOUBLE) AS hi, 1.0::DOUBLE AS t)"]
    for k in range(rounds):
        parts.append(f"""l{k} AS MATERIALIZED (SELECT i, exp(lo + (hi - lo) * i / {grid - 1}) AS t, (hi - lo) / {grid - 1} AS step, avg(ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END / exp(lo + (hi - lo) * i / {grid - 1})))) AS loss FROM z, b{k}, range({grid}) g(i) WHERE split = 'fit' GROUP BY i, lo, hi),
b{k + 1} AS MATERIALIZED (SELECT ln(t) - step AS lo, ln(t) + step AS hi, t FROM l{k} ORDER BY loss, i LIMIT 1)""")
    return ", ".join(parts)


@query(f"""WITH {LOGITS}, {_temperature_sql()} SELECT split, round(any_value(t), 6) AS temperature, round(avg(ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))), 6) AS nll_before, round(avg(ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END / t))), 6) AS nll_after FROM z, b3 GROUP BY split""")
def temperature_fit(spark, sf_dir):
    """Temperature of least NLL on the fit half, and the NLL of both halves before and after."""
    s = scored(spark, sf_dir)
    t = probs.fit_temperature(s.filter("split = 'fit'"), "p", "y")
    z = probs.logit(F.col("p"))
    loss = lambda k: F.avg(F.ln(1 + F.exp(F.when(F.col("y") == 1, -z).otherwise(z) / F.lit(k))))
    return rounded(s.groupBy("split").agg(F.lit(t).alias("temperature"), loss(1.0).alias("nll_before"), loss(t).alias("nll_after")))


def _newton_sql(rounds: int = 12) -> str:
    parts = ["s0 AS (SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(rounds):
        parts.append(f"""g{k} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum(r * z) AS ga, sum(r) AS gb, sum(w * z * z) AS haa, sum(w * z) AS hab, sum(w) AS hbb FROM (SELECT a, b, z, q - y AS r, q * (1 - q) AS w FROM (SELECT a, b, z, y, 1 / (1 + exp(-(a * z + b))) AS q FROM z, s{k} WHERE split = 'fit'))),
s{k + 1} AS MATERIALIZED (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})""")
    return ", ".join(parts)


@query(f"""WITH {LOGITS}, {_newton_sql()} SELECT id, round(a, 6) AS slope, round(b, 6) AS intercept, round(1 / (1 + exp(-(a * z + b))), 6) AS calibrated FROM z, s12""")
def platt_fit(spark, sf_dir):
    s = scored(spark, sf_dir)
    a, b = probs.fit_platt(s.filter("split = 'fit'"), "p", "y")
    q = probs.sigmoid(F.lit(a) * probs.logit(F.col("p")) + F.lit(b))
    return rounded(s.select("id", F.lit(a).alias("slope"), F.lit(b).alias("intercept"), q.alias("calibrated")))


ISOTONIC = f"""{SCORED}, x AS (SELECT split, round(p, 2) AS x, sum(y) AS s, count(*) AS w FROM scored GROUP BY 1, 2), k AS MATERIALIZED (SELECT *, row_number() OVER o AS i, sum(s) OVER o AS cs, sum(w) OVER o AS cw FROM x WINDOW o AS (PARTITION BY split ORDER BY x)),
m AS MATERIALIZED (SELECT j.split, j.i AS j, k.i AS k, (k.cs - j.cs + j.s) / (k.cw - j.cw + j.w)::DOUBLE AS v FROM k j JOIN k ON k.split = j.split AND k.i >= j.i),
v AS (SELECT split, i, max(low) AS v FROM (SELECT k.split, k.i, m.j, min(m.v) AS low FROM k JOIN m ON m.split = k.split AND m.j <= k.i AND m.k >= k.i GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(f"""WITH {ISOTONIC} SELECT k.split, min(x) AS x_low, max(x) AS x_high, round(v, 6) AS value, CAST(sum(w) AS BIGINT) AS weight FROM k JOIN v USING (split, i) GROUP BY k.split, v""")
def isotonic_knots(spark, sf_dir):
    """Steps of the isotonic fit of each split; in SQL as the largest of the least means."""
    return rounded(probs.pava(scored(spark, sf_dir).withColumn("p", F.round("p", 2)), "split", "p", "y"))


@query(f"""WITH {ISOTONIC}, n AS (SELECT k.split, min(x) AS a, max(x) AS b, v FROM k JOIN v USING (split, i) GROUP BY k.split, v), q AS (SELECT id, split, u FROM scored),
l AS (SELECT q.*, max(a) FILTER (a <= u) AS la, min(a) FILTER (a > u) AS ra FROM q JOIN n USING (split) GROUP BY ALL)
SELECT l.id, round(CASE WHEN lo.a IS NULL THEN hi.v WHEN hi.a IS NULL OR u <= lo.b THEN lo.v ELSE lo.v + (hi.v - lo.v) * (u - lo.b) / (hi.a - lo.b) END, 6) AS calibrated FROM l LEFT JOIN n lo ON lo.split = l.split AND lo.a = l.la LEFT JOIN n hi ON hi.split = l.split AND hi.a = l.ra""")
def isotonic_apply(spark, sf_dir):
    """Another score calibrated by the knots of its split, straight lines between steps."""
    s = scored(spark, sf_dir)
    knots = probs.pava(s.withColumn("p", F.round("p", 2)), "split", "p", "y")
    return rounded(probs.apply_isotonic(s.select("id", "split", "u"), knots, "split", "u", "calibrated").select("id", "calibrated"))


@query(f"""WITH {SCORED} SELECT id, round(exp(ln(p / (1 - p)) / 2) / (exp(ln(p / (1 - p)) / 2) + 1), 6) AS sharp, round(1 / (1 + exp(-u)), 6) AS sig FROM scored""")
def softmax_and_sigmoid(spark, sf_dir):
    s = scored(spark, sf_dir)
    logits = F.array(probs.logit(F.col("p")), F.lit(0.0))
    return rounded(s.select("id", F.get(probs.softmax(logits, 2.0), 0).alias("sharp"), probs.sigmoid(F.col("u")).alias("sig")))


@query(f"""WITH {SCORED} SELECT q AS split, n, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95, round(mx, 6) AS "max" FROM (SELECT split AS q, count(*) AS n, avg(u) AS mean, quantile_cont(u, 0.5) AS p50, quantile_cont(u, 0.95) AS p95, max(u) AS mx FROM scored GROUP BY split)""")
def latency_summary(spark, sf_dir):
    g = scored(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.avg("u").alias("mean"), F.percentile("u", 0.5).alias("p50"), F.percentile("u", 0.95).alias("p95"), F.max("u").alias("max"))
    return rounded(g)
