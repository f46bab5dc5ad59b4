"""Further operators of the inventory: projections, walk-forward fits, gates, audits, packing, proofs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from decisa.functions import stats, text, windows
from decisa.operators import asof, corpus
from decisa.operators import panel as books
from decisa.operators import ranks, removal, resample, walkforward
from decisa.plans.base import PANEL, SCORED, panel, query, rounded, scored, table
from decisa.session import fresh_path
from decisa.sources import readers, sinks

W = "PARTITION BY asset ORDER BY day"


@query(f"""WITH {PANEL} SELECT asset, dn AS day, round(close, 6) AS close, round(qv, 6) AS qv FROM panel""")
def leakage_safe_projection(spark, sf_dir):
    """Only key, time and feature values of a record reach a model: availability stamps and labels stay behind."""
    p = panel(spark, sf_dir)
    r = p.select("asset", "dn", F.create_map(*[x for c in ("close", "qv") for x in (F.lit(c), F.struct(F.col(c).alias("value"), F.col("dn").alias("available")))]).alias("features"), F.lit(1).alias("label"))
    f = F.transform_values("features", lambda k, v: v["value"])
    return rounded(r.select("asset", F.col("dn").alias("day"), f["close"].alias("close"), f["qv"].alias("qv")))


@query("""SELECT conv_id, turn, sha256('{"criteria":' || CASE turn % 3 WHEN 0 THEN '{}' ELSE '{"a":[2.0,1],"b":null}' END || ',"instructions":' || to_json('about ' || coalesce(role, '')) || ',"state":{"text":' || coalesce(to_json(text), 'null') || ',"turn":' || turn || '},"type":"boolean"}') AS visible FROM conversations""")
def visible_input_hash(spark, sf_dir):
    """The identity of what a model sees of a question: state, type, instructions and criteria, whatever the order of
    their fields; ids and answers have no part in it."""
    t = table(spark, sf_dir, "conversations")
    state = F.to_json(F.struct("turn", "text"), {"ignoreNullFields": "false"})
    criteria = F.when(F.col("turn") % 3 == 1, F.lit('{"b":null, "a":[2.0, 1]}')).when(F.col("turn") % 3 == 2, F.lit('{"a":[2.0,1],"b":null}'))
    visible = text.visible_input(state, F.lit("boolean"), F.concat(F.lit("about "), F.coalesce("role", F.lit(""))), criteria)
    return t.select("conv_id", "turn", F.sha2(visible, 256).alias("visible"))


@query("""SELECT conv_id, md5(max(text) FILTER (turn = 1)) AS candidate FROM conversations GROUP BY conv_id""")
def candidate_by_pointer(spark, sf_dir):
    """The content that a pointer names, looked up in a conversation's array."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.concat(F.lit("/messages/"), "turn", F.lit("/content")).alias("pointer"), "text")).alias("c"))
    hit = F.get(F.filter("c", lambda x: text.pointer_index(x["pointer"]) == 1), 0)
    return t.select("conv_id", F.md5(hit["text"]).alias("candidate"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(not found|failed|error|no results?)\b') THEN 'vetoed' WHEN quality = 0 THEN 'drop' ELSE 'keep' END AS verdict FROM documents JOIN labels USING (doc_id)""")
def label_veto(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.when(F.col("text").rlike(r"(?i)\b(not found|failed|error|no results?)\b"), "vetoed").when(F.col("quality") == 0, "drop").otherwise("keep").alias("verdict"))


@query(r"""WITH d AS (SELECT doc_id, lang, coalesce(source, '') || CASE doc_id % 5 WHEN 0 THEN '/Workflow_challenge' WHEN 1 THEN '/context  relevance-OOD' WHEN 2 THEN '/workflow_v2' WHEN 3 THEN '/abstention' ELSE '' END AS provenance FROM documents)
SELECT doc_id, provenance FROM d WHERE NOT regexp_matches(regexp_replace(lower(provenance), '[-_\s]+', ' ', 'g'), 'abstention survey|workflow challenge|workflow v2 evaluation|context relevance test|context relevance ood')""")
def provenance_filter(spark, sf_dir):
    """Documents that don't come from an evaluation set, by the names that their provenance may hold in any spelling."""
    names = F.array(*map(F.lit, ("/Workflow_challenge", "/context  relevance-OOD", "/workflow_v2", "/abstention", "")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.get(names, F.pmod("doc_id", F.lit(5)).cast("int"))).alias("provenance"))
    return d.filter(~text.evaluation_derived(F.col("provenance")))


@query("SELECT event_id, json_exists(props, '$.secret') AS forbidden, len(json_keys(props)) AS keys FROM events")
def forbidden_keys(spark, sf_dir):
    """Rows whose JSON has a disallowed key at its top."""
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", F.array_contains(keys, "secret").alias("forbidden"), F.size(keys).alias("keys"))


@query(f"""WITH {PANEL}, s AS (SELECT asset, dn, close, avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, lag(close) OVER ({W}) AS b FROM panel)
SELECT asset, dn AS day, close < m AND close > b AS pullback, close > 1.5 * m AS extended, close < 0.5 * m AS breaking, CASE WHEN b IS NOT NULL THEN close < b * 0.92::DOUBLE END AS fires FROM s""")
def state_predicates(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("day")
    c, m, b = F.col("close"), F.avg("close").over(w.rowsBetween(-4, 0)), F.lag("close").over(w)
    return p.select("asset", F.col("dn").alias("day"), ((c < m) & (c > b)).alias("pullback"), (c > 1.5 * m).alias("extended"), (c < 0.5 * m).alias("breaking"), F.when(b.isNotNull(), c < b * 0.92).alias("fires"))


@query(f"""WITH {SCORED}, m AS (SELECT id, y AS label, 1 AS pri FROM scored WHERE u < 0.8 UNION ALL SELECT id, 1 - y, 2 FROM scored WHERE toxic = 1), l AS (SELECT id, arg_max(label, pri) AS label FROM m GROUP BY id)
SELECT count(*) AS n, count(l.label) AS labeled, count(*) - count(l.label) AS unlabeled, count(*) FILTER ((p >= 0.5)::INT = l.label) AS right_ FROM scored LEFT JOIN l USING (id)""")
def results_to_labels(spark, sf_dir):
    """Results with the last label map that knows them; the unlabeled are counted."""
    s = scored(spark, sf_dir).drop("label")
    maps = s.filter("u < 0.8").select("id", F.col("y").alias("label"), F.lit(1).alias("pri")).unionByName(s.filter("toxic = 1").select("id", (1 - F.col("y")).alias("label"), F.lit(2).alias("pri")))
    j = s.join(maps.groupBy("id").agg(F.max_by("label", "pri").alias("label")), "id", "left")
    return j.agg(F.count("*").alias("n"), F.count("label").alias("labeled"), (F.count("*") - F.count("label")).alias("unlabeled"), F.count_if((F.col("p") >= 0.5).cast("int") == F.col("label")).alias("right_"))


@query(f"""WITH {PANEL}, m AS (SELECT user_id AS asset, CAST(ts AS DATE) AS day, count(*) AS bars, last(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'view') AS last_view, first(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'view') AS first_view FROM events GROUP BY 1, 2)
SELECT p.asset, dn AS day, round(last_view, 6) AS last_view, round(first_view, 6) AS first_view, bars FROM panel p JOIN m USING (asset, day) WHERE bars >= 2""")
def snapshot_join(spark, sf_dir):
    """Daily last and first non-null snapshots joined to the panel, days with few bars left out."""
    e = table(spark, sf_dir, "events")
    at, view = F.struct("ts", "event_id"), F.col("event_type") == "view"
    m = e.groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("day")).agg(F.count("*").alias("bars"), F.max_by(F.when(view, F.col("value")), F.when(view, at)).alias("last_view"), F.min_by(F.when(view, F.col("value")), F.when(view, at)).alias("first_view"))
    return rounded(panel(spark, sf_dir).join(m.filter("bars >= 2"), ["asset", "day"]).select("asset", F.col("dn").alias("day"), "last_view", "first_view", "bars"))


@query(f"""WITH {SCORED}, g AS (SELECT id % 40 AS c, count(*) AS n, sum(u - p) AS k FROM scored GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS m FROM g),
d AS (SELECT r.b, CAST(('0x' || substring(sha256('pair|' || r.b || '|' || j.j), 1, 8)) AS BIGINT) % (SELECT max(m) FROM o) AS i FROM range(100) r(b), range((SELECT max(m) FROM o)) j(j)),
e AS (SELECT d.b, sum(k) / sum(n) AS mean FROM d JOIN o USING (i) GROUP BY d.b) SELECT count(*) AS samples, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.975), 6) AS high FROM e""")
def paired_bootstrap(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("c", F.col("id") % 40)
    e = resample.paired_bootstrap(s, "c", "p", "u", 100, "pair")
    return rounded(e.agg(F.count("*").alias("samples"), F.avg("mean").alias("mean"), F.percentile("mean", 0.975).alias("high")))


def _features(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("day")
    p = p.withColumns({"x1": F.ln(F.col("close") + 1), "x2": F.ln(F.col("qv") + 1), "x3": F.col("n").cast("double")})
    return p.withColumn("y", F.when(F.datediff(F.lead("day").over(w), F.col("day")) == 1, F.ln(F.lead("close").over(w) + 1))).filter("y is not null")


@query()
def ridge_lambda_by_cv(spark, sf_dir):
    """Mean squared error of each lambda over forward-chained date chunks with an embargo, and the chosen one."""
    return rounded(walkforward.select_lambda(_features(spark, sf_dir), "dn", ["x1", "x2", "x3"], "y", [0.0, 1.0, 10.0, 100.0]))


@query()
def ridge_fold_evaluation(spark, sf_dir):
    """Out-of-sample scores of a fit before day 19740 on the days after it."""
    return rounded(walkforward.evaluate_fold(_features(spark, sf_dir), "dn", "asset", ["x1", "x2", "x3"], "y", 19740, 1.0))


@query()
def ridge_refit_policies(spark, sf_dir):
    """Frozen, expanding and rolling refits over test days: error and coefficient drift by policy."""
    return rounded(walkforward.refit_policies(_features(spark, sf_dir), "dn", ["x1", "x2", "x3"], "y", 19735, 5, 10, 1.0))


@query()
def model_scored_ledger(spark, sf_dir):
    """Each day's predictions of a model refitted on the days before, later resolved against what happened."""
    return rounded(walkforward.scored_ledger(_features(spark, sf_dir), "dn", "asset", ["x1", "x2", "x3"], "y", 19735, 1.0))


def _descent_sql(steps: int) -> str:
    parts = [f"""{SCORED}, m AS MATERIALIZED (SELECT avg(u) AS mu, stddev_pop(u) AS su, avg(p) AS mp, stddev_pop(p) AS sp FROM scored), x AS MATERIALIZED (SELECT (u - mu) / su AS a, (p - mp) / sp AS b, y FROM scored, m), w0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb)"""]
    for k in range(steps):
        parts.append(f"""w{k + 1} AS MATERIALIZED (SELECT any_value(w) - avg(q - y) AS w, any_value(wa) - (avg((q - y) * a) + 0.001 * any_value(wa)) AS wa, any_value(wb) - (avg((q - y) * b) + 0.001 * any_value(wb)) AS wb FROM (SELECT *, 1 / (1 + exp(-(w + wa * a + wb * b))) AS q FROM x, w{k}))""")
    return ", ".join(parts)


@query(f"""WITH {_descent_sql(60)} SELECT 'intercept' AS name, round(w, 6) AS coefficient FROM w60 UNION ALL SELECT 'u', round(wa, 6) FROM w60 UNION ALL SELECT 'p', round(wb, 6) FROM w60""")
def logistic_baseline(spark, sf_dir):
    """Logistic regression by gradient descent, one aggregate a step."""
    s = scored(spark, sf_dir)
    return rounded(walkforward.fit_logistic(s, ["u", "p"], "y", 60, 1.0))


@query()
def brier_baseline(spark, sf_dir):
    """The same descent on the Brier score, and ten boosted stumps, by their scores on the rows."""
    s = scored(spark, sf_dir)
    brier = walkforward.fit_logistic(s, ["u", "p"], "y", 40, 4.0, objective="brier").select(F.concat(F.lit("brier:"), "name").alias("name"), "coefficient")
    stumps = walkforward.fit_stumps(s, ["u", "p"], "y", 10, 0.5).select(F.concat(F.lit("stump:"), F.col("round").cast("string"), F.lit(":"), "feature").alias("name"), F.col("gain").alias("coefficient"))
    return rounded(brier.unionByName(stumps))


@query(f"""WITH {PANEL}, t AS (SELECT dn, close, ntile(3) OVER (PARTITION BY dn ORDER BY close, asset) AS a, ntile(3) OVER (PARTITION BY dn ORDER BY qv, asset) AS b FROM panel), d AS (SELECT dn, a, b, avg(close) AS m, count(*) AS n FROM t GROUP BY 1, 2, 3)
SELECT a, b, round(avg(m), 6) AS mean_of_days, round(sum(m * n) / sum(n), 6) AS pooled, count(*) AS days FROM d GROUP BY a, b""")
def interaction_grid(spark, sf_dir):
    p = panel(spark, sf_dir)
    t = p.withColumns({"a": F.ntile(3).over(Window.partitionBy("dn").orderBy("close", "asset")), "b": F.ntile(3).over(Window.partitionBy("dn").orderBy("qv", "asset"))})
    d = t.groupBy("dn", "a", "b").agg(F.avg("close").alias("m"), F.count("*").alias("k"))
    return rounded(d.groupBy("a", "b").agg(F.avg("m").alias("mean_of_days"), (F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("pooled"), F.count("*").alias("days")))


@query(f"""WITH {SCORED}, m AS (SELECT split, count(*) AS n, avg(correct::INT::DOUBLE) AS acc, count(*) FILTER (p >= 0.6 AND y = 0) AS fp, avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS nll, avg((p - y) * (p - y)) AS brier, avg((conf >= 0.75)::INT::DOUBLE) AS coverage, avg((p >= 0.5)::INT::DOUBLE) FILTER (y = 1) AS recall FROM scored GROUP BY split),
g AS (SELECT split, n, unnest([{{'g': 'accuracy', 'ok': acc >= 0.7}}, {{'g': 'false_positives', 'ok': fp <= 5}}, {{'g': 'nll', 'ok': nll <= 0.6}}, {{'g': 'brier', 'ok': brier <= 0.15}}, {{'g': 'coverage', 'ok': coverage >= 0.3}}, {{'g': 'recall', 'ok': recall >= 0.5}}]) AS x FROM m)
SELECT split, x.g AS gate, CASE WHEN n < 30 THEN 'PENDING' WHEN x.ok THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")
def gate_battery(spark, sf_dir):
    """Named gates over metrics: PASS, FAIL, or PENDING below the least number of rows."""
    m = scored(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.count_if((F.col("p") >= 0.6) & (F.col("y") == 0)).alias("fp"),
        F.avg(-F.ln(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("nll"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.avg((F.col("conf") >= 0.75).cast("double")).alias("coverage"), F.avg(F.when(F.col("y") == 1, (F.col("p") >= 0.5).cast("double"))).alias("recall"))
    verdict = lambda ok: F.when(F.col("n") < 30, "PENDING").when(ok, "PASS").otherwise("FAIL")
    rules = {"accuracy": F.col("acc") >= 0.7, "false_positives": F.col("fp") <= 5, "nll": F.col("nll") <= 0.6, "brier": F.col("brier") <= 0.15, "coverage": F.col("coverage") >= 0.3, "recall": F.col("recall") >= 0.5}
    gates = F.array(*[F.struct(F.lit(name).alias("gate"), verdict(ok).alias("verdict")) for name, ok in rules.items()])
    return m.select("split", F.inline(gates))


@query("""WITH d AS (SELECT conv_id, length(text) AS c, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) > 1 AS dropped FROM conversations)
SELECT count(*) AS turns, count(*) FILTER (dropped) AS removed, CAST(coalesce(sum(c) FILTER (dropped), 0) AS BIGINT) AS chars_removed, CAST(sum(c) AS BIGINT) AS chars FROM d""")
def dedup_savings(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    d = t.withColumn("dropped", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1)
    c = F.length("text").cast("long")
    return d.agg(F.count("*").alias("turns"), F.count_if("dropped").alias("removed"), F.coalesce(F.sum(F.when(F.col("dropped"), c)), F.lit(0)).alias("chars_removed"), F.sum(c).alias("chars"))


@query(f"""WITH {SCORED}, s AS (SELECT id % 5 AS seed, avg(correct::INT::DOUBLE) AS acc, avg(p) AS p FROM scored GROUP BY 1) SELECT count(*) AS runs, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, round(avg(acc - p), 6) AS contrast FROM s""")
def multi_seed_summary(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy((F.col("id") % 5).alias("seed")).agg(F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("p").alias("p"))
    return rounded(s.agg(F.count("*").alias("runs"), F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("sd"), F.avg(F.col("acc") - F.col("p")).alias("contrast")))


@query(f"""WITH {SCORED}, a AS (SELECT id, toxic = 1 AS want, a.arm, CASE a.arm WHEN 'p' THEN p ELSE u END >= 0.6 AS got, ceil(length(coalesce(text, '')) / 4) AS tokens, CASE a.arm WHEN 'p' THEN 5 + 100 * u ELSE 1 + 10 * p END AS ms
  FROM scored JOIN documents ON doc_id = id, (VALUES ('p'), ('u')) a(arm)), r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY ms) AS k, count(*) OVER (PARTITION BY arm) AS n FROM a)
SELECT arm, count(*) FILTER (want AND got) AS right_drops, count(*) FILTER (NOT want AND got) AS false_drops, count(*) FILTER (want AND NOT got) AS missed, CAST(coalesce(sum(tokens) FILTER (got), 0) AS BIGINT) AS tokens_cut, CAST(coalesce(sum(tokens) FILTER (got AND NOT want), 0) AS BIGINT) AS tokens_lost,
  CAST(sum(tokens) AS BIGINT) AS tokens, round(max(ms) FILTER (k = ceil(0.5 * n)), 6) AS p50_ms, round(max(ms) FILTER (k = ceil(0.95 * n)), 6) AS p95_ms FROM r GROUP BY arm""")
def filter_value_arms(spark, sf_dir):
    """What two filters cut, rightly and wrongly, in rows and tokens, and the nearest-rank percentiles of their latency."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    arm = lambda name, c, ms: F.struct(F.lit(name).alias("arm"), (F.col(c) >= 0.6).alias("got"), ms.alias("ms"))
    s = scored(spark, sf_dir).join(d, "id").select((F.col("toxic") == 1).alias("want"), "tokens", F.inline(F.array(arm("p", "p", 5 + 100 * F.col("u")), arm("u", "u", 1 + 10 * F.col("p")))))
    w, g, t = F.col("want"), F.col("got"), F.col("tokens")
    s = ranks.numbered(s, ["arm"], [F.col("ms")], "k", "n")
    at = lambda q: F.max(F.when(F.col("k") == F.ceil(q * F.col("n")), F.col("ms")))
    out = s.groupBy("arm").agg(
        F.count_if(w & g).alias("right_drops"), F.count_if(~w & g).alias("false_drops"), F.count_if(w & ~g).alias("missed"), F.coalesce(F.sum(F.when(g, t)), F.lit(0)).alias("tokens_cut"),
        F.coalesce(F.sum(F.when(g & ~w, t)), F.lit(0)).alias("tokens_lost"), F.sum(t).alias("tokens"), at(F.lit(0.5)).alias("p50_ms"), at(F.lit(0.95)).alias("p95_ms"),
    )
    return rounded(out)


@query(f"""WITH {SCORED}, v AS (SELECT id, CASE WHEN y <> toxic THEN 1 ELSE 0 END + CASE WHEN y <> (p >= 0.5)::INT THEN 1 ELSE 0 END AS flips, abs(p - u) AS spread FROM scored)
SELECT id, flips, round(spread, 6) AS spread, row_number() OVER (ORDER BY flips DESC, spread DESC, id) AS place FROM v""")
def review_queue(spark, sf_dir):
    """Most flips first, then the widest spread, then the id; places come from ranges and their counts."""
    v = scored(spark, sf_dir).select("id", ((F.col("y") != F.col("toxic")).cast("int") + (F.col("y") != (F.col("p") >= 0.5).cast("int")).cast("int")).alias("flips"), F.abs(F.col("p") - F.col("u")).alias("spread"))
    return rounded(ranks.numbered(v, [], [F.desc("flips"), F.desc("spread"), F.col("id")]))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, sha256(CAST(doc_id AS VARCHAR))) AS k, CAST(('0x' || substring(sha256('p:' || doc_id), 1, 8)) AS BIGINT) % 10 = 0 AS frozen FROM documents)
SELECT doc_id, CASE WHEN frozen THEN 'frozen' WHEN k <= 5 THEN 'reserved' ELSE 'train' END AS pool FROM r""")
def pool_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    d = ranks.numbered(d.withColumn("h", F.sha2(F.col("doc_id").cast("string"), 256)), ["source"], [F.desc("n_chars"), F.col("h")], "k")
    return d.select("doc_id", F.when(text.hash_bucket(F.col("doc_id").cast("string"), "p", 10) == 0, "frozen").when(F.col("k") <= 5, "reserved").otherwise("train").alias("pool"))


@query(f"""WITH {PANEL}, r AS (SELECT asset, dn, CASE WHEN dn - lag(dn) OVER ({W}) = 1 THEN close / lag(close) OVER ({W}) - 1 END AS r FROM panel WHERE close > 0)
SELECT asset, dn AS day, round(exp(sum(ln(1 + coalesce(r, 0) / 100)) OVER (PARTITION BY asset ORDER BY dn)), 6) AS equity FROM r""")
def compounded_equity(spark, sf_dir):
    p = panel(spark, sf_dir).filter("close > 0")
    r = p.withColumn("r", F.col("close") / windows.contiguous_lag("asset", "day", "close", 1) - 1)
    w = Window.partitionBy("asset").orderBy("dn").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(r.select("asset", F.col("dn").alias("day"), F.exp(F.sum(F.ln(1 + F.coalesce("r", F.lit(0.0)) / 100)).over(w)).alias("equity")))


@query("""SELECT part, count(*) AS n FROM (SELECT least(l_quantity::INT % 7 || '-' || l_linenumber, l_linenumber || '-' || l_quantity::INT % 7) AS part FROM lineitem) GROUP BY part""")
def symmetry_groups(spark, sf_dir):
    """A canonical id that a pair and its mirror image share: the smallest of its forms."""
    q, n = (F.col("l_quantity").cast("int") % 7).cast("string"), F.col("l_linenumber").cast("string")
    forms = F.array(F.concat_ws("-", q, n), F.concat_ws("-", n, q))
    return table(spark, sf_dir, "lineitem").groupBy(F.array_min(forms).alias("part")).agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL} SELECT asset, dn AS day, 'asset ' || asset || ' n=' || n || CASE WHEN fund IS NULL THEN ' <no settlement>' ELSE '' END AS state FROM panel""")
def rendered_states(spark, sf_dir):
    return panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), F.concat(F.format_string("asset %d n=%d", "asset", "n"), F.when(F.col("fund").isNull(), " <no settlement>").otherwise("")).alias("state"))


@query(r"""SELECT page_id, regexp_replace(url, '/(\d+)', '/9\1') AS changed FROM pages""")
def superseded_urls(spark, sf_dir):
    """The first number of a path changed by a fixed rule, as a later version of the same fact."""
    u = F.col("url")
    at = F.regexp_instr(u, F.lit(r"/\d+"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(at > 0, F.concat(F.substr(u, F.lit(1), at), F.lit("9"), F.substr(u, at + 1))).otherwise(u).alias("changed"))


@query("""SELECT conv_id, count(*) FILTER (turn % 3 = 1 AND role = 'assistant' AND conv_id % 2 = 0) = 0 AS restored, count(*) FILTER (turn % 3 = 1) AS dropped, count(*) AS turns FROM conversations GROUP BY conv_id""")
def reversible_removal(spark, sf_dir):
    """Drop every third turn with a content-free manifest, restore, and compare hashes with the original; some turns
    are kept badly and must be noticed."""
    bad = (F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0)
    return removal.prove(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.col("turn") % 3 == 1, bad)


@query(f"""WITH {PANEL}, m AS (SELECT asset, dn, avg(close) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f, avg(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s, row_number() OVER ({W}) AS k FROM panel), x AS (SELECT asset, dn, k >= 6 AND f > s AS up FROM m)
SELECT asset, dn AS day, CASE WHEN up AND NOT coalesce(lag(up) OVER (PARTITION BY asset ORDER BY dn), false) THEN 'buy' WHEN NOT up AND coalesce(lag(up) OVER (PARTITION BY asset ORDER BY dn), false) THEN 'sell' ELSE 'hold' END AS action FROM x""")
def crossover_decisions(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("day")
    x = p.withColumn("up", (F.row_number().over(w) >= 6) & (F.avg("close").over(w.rowsBetween(-2, 0)) > F.avg("close").over(w.rowsBetween(-5, 0))))
    was = F.coalesce(F.lag("up").over(w), F.lit(False))
    return x.select("asset", F.col("dn").alias("day"), F.when(F.col("up") & ~was, "buy").when(~F.col("up") & was, "sell").otherwise("hold").alias("action"))


@query(f"""WITH {SCORED} SELECT id, k AS candidate, CAST(pos AS INT) AS pos, round(CASE WHEN k = '1' THEN p ELSE 1 - p END, 6) AS prob FROM scored, (VALUES ('0', 0), ('1', 1)) c(k, pos)""")
def candidate_expansion(spark, sf_dir):
    """A question's row as one row a candidate, in order."""
    s = scored(spark, sf_dir).select("id", "probs", F.posexplode(F.array_sort(F.map_keys("probs"))).alias("pos", "candidate"))
    return rounded(s.select("id", "candidate", "pos", F.element_at("probs", F.col("candidate")).alias("prob")))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(length(text), 0) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r(conv_id, k, turn, "row", used) AS (SELECT conv_id, k, turn, 0, c FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, o.turn, CASE WHEN r.used + o.c <= 1200 THEN r."row" ELSE r."row" + 1 END, CASE WHEN r.used + o.c <= 1200 THEN r.used + o.c ELSE o.c END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, "row", min(turn) AS "first", max(turn) AS "last", CAST(max(used) AS BIGINT) AS used FROM r GROUP BY 1, 2""")
def token_budget_packing(spark, sf_dir):
    """Turns of a conversation packed in order into rows of at most 1,200 characters; a longer turn has its own row."""
    t = table(spark, sf_dir, "conversations").withColumn("cost", F.length("text"))
    return removal.pack(t, "conv_id", "turn", "cost", 1200)


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2), l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS lines FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderstatus, round(o_totalprice - lines, 2) AS off FROM orders JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' OR abs(o_totalprice - lines) > 1e-9""")
def order_outcome_audit(spark, sf_dir):
    """Orders that are not filled, or whose total differs from their lines."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("lines"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    off = F.col("o_totalprice") - F.col("lines")
    return o.filter((F.col("o_orderstatus") != "F") | (F.abs(off) > 1e-9)).select("o_orderkey", "o_orderstatus", F.round(off, 2).alias("off"))


@query(f"""WITH {PANEL}, l AS (SELECT asset, dn, dn - lag(dn) OVER (PARTITION BY asset ORDER BY dn) AS gap FROM panel), m AS (SELECT max(dn) AS last FROM panel)
SELECT asset, count(*) AS rows, count(*) FILTER (gap > 1) AS gaps, CAST((SELECT last FROM m) - max(dn) AS INT) AS age FROM l GROUP BY asset""")
def ledger_health(spark, sf_dir):
    p = panel(spark, sf_dir)
    last = p.agg(F.max("dn").alias("last"))
    g = p.withColumn("gap", F.col("dn") - F.lag("dn").over(Window.partitionBy("asset").orderBy("dn"))).groupBy("asset").agg(F.count("*").alias("rows"), F.count_if(F.col("gap") > 1).alias("gaps"), F.max("dn").alias("m"))
    return g.join(F.broadcast(last)).select("asset", "rows", "gaps", (F.col("last") - F.col("m")).alias("age"))


@query(f"""WITH {PANEL}, t AS (SELECT asset, max(dn) AS seen FROM panel WHERE dn < 19740 GROUP BY asset) SELECT p.asset, dn AS day FROM panel p LEFT JOIN t USING (asset) WHERE dn > coalesce(seen, 0)""")
def incremental_tail(spark, sf_dir):
    """Only rows newer than what a store already holds for each key."""
    p = panel(spark, sf_dir)
    seen = p.filter("dn < 19740").groupBy("asset").agg(F.max("dn").alias("seen"))
    return p.join(seen, "asset", "left").filter(F.col("dn") > F.coalesce("seen", F.lit(0))).select("asset", F.col("dn").alias("day"))


@query("""WITH p AS (SELECT 'labels' AS selection, doc_id FROM labels UNION ALL SELECT 'and a stranger', doc_id FROM labels UNION ALL SELECT 'and a stranger', -1)
SELECT selection, count(d.doc_id) AS rows, count(DISTINCT sha256(text)) AS texts, count(d.doc_id) = count(*) AS whole FROM p LEFT JOIN documents d USING (doc_id) GROUP BY selection""")
def frozen_selection(spark, sf_dir):
    """Pinned lists of ids joined back to their source: every id must be found, and one of the lists has an id too many."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("found"))
    ids = table(spark, sf_dir, "labels").select("doc_id")
    pins = ids.withColumn("selection", F.lit("labels")).unionByName(ids.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"))).withColumn("selection", F.lit("and a stranger")))
    j = pins.join(d, "doc_id", "left").groupBy("selection")
    return j.agg(F.count("found").alias("rows"), F.countDistinct(F.sha2("text", 256)).alias("texts"), (F.count("found") == F.count("*")).alias("whole"))


@query(f"""WITH {SCORED} SELECT id, CASE WHEN u > 0.9 AND y = 1 THEN 'false' WHEN u > 0.9 OR u < 0.05 THEN NULL WHEN y = 1 THEN 'true' WHEN toxic = 1 THEN 'false' ELSE 'uncertain' END AS label,
CASE WHEN y = 1 THEN CASE WHEN u > 0.9 THEN 'old' ELSE 'n' || id END END AS note, CASE WHEN u > 0.9 AND y = 0 THEN 'empty' WHEN u < 0.05 THEN 'unrecognized' END AS fault FROM scored""")
def label_normalization(spark, sf_dir):
    """Labels in two CSV files whose columns have other names and another order, in all spellings, with empty and strange
    ones, and rows that a later one replaces."""
    pick = lambda words: F.get(F.array(*map(F.lit, words)), F.floor(F.col("u") * len(words)).cast("int"))
    word = F.when(F.col("u") > 0.9, "").when(F.col("u") < 0.05, "hm").when(F.col("y") == 1, F.concat(F.lit(" "), F.upper(pick(readers.TRUE_WORDS)))).when(F.col("toxic") == 1, pick(readers.FALSE_WORDS)).otherwise(pick(readers.UNCERTAIN_WORDS))
    rows = scored(spark, sf_dir).select(F.col("id").cast("string").alias("id"), word.alias("word"), F.when(F.col("y") == 1, F.concat(F.lit("n"), "id")).otherwise("").alias("n"), "y")
    folder = fresh_path(spark, "labels")
    first = lambda word_, note: rows.filter("y = 1").select(word_.alias("Label (owner)"), F.col("id").alias("Record_ID "), note.alias("Notes"))
    first(F.lit("keep"), F.lit("old")).coalesce(1).write.option("header", True).csv(f"{folder}/a/1")
    first(F.col("word"), F.col("n")).write.option("header", True).csv(f"{folder}/a/2")
    rows.filter("y = 0").select(F.col("id").alias("record_id_of"), F.col("n").alias("evidence"), F.col("word").alias("LABEL")).write.option("header", True).csv(f"{folder}/b")
    got = readers.read_label_csv(spark, f"{folder}/a/*").unionByName(readers.read_label_csv(spark, f"{folder}/b"))
    return got.select(F.col("record_id").cast("long").alias("id"), "label", "note", "fault")


@query("""WITH r AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN CASE length(text) % 3 WHEN 0 THEN 'tool' ELSE 'assistant' END WHEN role = 'user' THEN CASE length(text) % 7 WHEN 0 THEN NULL ELSE 'user' END ELSE role END AS role FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, last(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_role FROM r WHERE role IS NOT NULL AND regexp_matches(text, '\\S')),
m AS (SELECT *, n - CASE WHEN n >= 2 AND end_role = 'assistant' THEN 1 ELSE 0 END AS h FROM k),
g AS (SELECT conv_id, any_value(h) AS h, max(role) FILTER (i = h - 1) AS tail, md5(max(text) FILTER (i = h)) AS reference, string_agg('/messages/' || i || '/content', ' ' ORDER BY i) FILTER (i < h - 3 AND role IN ('assistant', 'tool')) AS eligible FROM m GROUP BY 1)
SELECT conv_id, h AS history, reference, eligible FROM g WHERE h >= 5 AND tail IN ('user', 'tool') AND eligible IS NOT NULL""")
def corpus_history(spark, sf_dir):
    """Conversations in an open corpus' roles as histories with the reference answer popped off, and what may be cut."""
    n = F.length("text")
    role = F.when(F.col("role") == "assistant", F.when(n % 3 == 0, "function").otherwise("gpt")).when(F.col("role") == "user", F.when(n % 7 == 0, "moderator").otherwise("human")).otherwise(F.col("role"))
    h = corpus.open_histories(table(spark, sf_dir, "conversations").withColumn("role", role), "conv_id", "turn", "role", "text")
    return h.select("conv_id", F.size("messages").cast("long").alias("history"), F.md5(F.col("reference").cast("binary")).alias("reference"), F.array_join("eligible", " ").alias("eligible"))


@query(f"""WITH {SCORED}, v AS (SELECT id, CASE WHEN y <> toxic THEN 1 ELSE 0 END + CASE WHEN y <> (p >= 0.5)::INT THEN 1 ELSE 0 END AS flips FROM scored)
SELECT id FROM v WHERE flips = 0 AND CAST(('0x' || substring(sha256('review:' || id), 1, 8)) AS BIGINT) % 10 = 0""")
def review_sample(spark, sf_dir):
    """A tenth of the rows that no one disputes, by hash, to be reviewed beside the queue; the share is the feature."""
    s = scored(spark, sf_dir)
    agreed = (F.col("y") == F.col("toxic")) & (F.col("y") == (F.col("p") >= 0.5).cast("int"))
    return s.filter(agreed & (text.hash_bucket(F.col("id").cast("string"), "review", 10) == 0)).select("id")


@query(f"""WITH {PANEL}, w AS (SELECT asset, dn, close, fund, count(*) OVER b AS k, max(close) OVER b AS top, avg(close) OVER b AS mean FROM panel WINDOW b AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
t AS (SELECT asset, dn, unnest([{{'t': 'trail', 'd': k = 5, 'f': close <= top * 0.92::DOUBLE}}, {{'t': 'below_average', 'd': k = 5, 'f': close < mean}}, {{'t': 'settled_high', 'd': fund IS NOT NULL, 'f': fund > 90}}]) AS x FROM w)
SELECT asset, dn AS day, x.t AS trigger, x.d AS defined, coalesce(x.d AND x.f, false) AS fires FROM t""")
def trigger_family(spark, sf_dir):
    """Exit triggers as pairs of whether they are defined and whether they fire, a row each."""
    p, b = panel(spark, sf_dir), Window.partitionBy("asset").orderBy("day").rowsBetween(-5, -1)
    full = F.count(F.lit(1)).over(b) == 5
    rules = {"trail": (full, F.col("close") <= F.max("close").over(b) * 0.92), "below_average": (full, F.col("close") < F.avg("close").over(b)), "settled_high": (F.col("fund").isNotNull(), F.col("fund") > 90)}
    each = F.array(*[F.struct(F.lit(name).alias("trigger"), defined.alias("defined"), F.coalesce(defined & fires, F.lit(False)).alias("fires")) for name, (defined, fires) in rules.items()])
    return p.select("asset", F.col("dn").alias("day"), each.alias("x")).select("asset", "day", F.inline("x"))


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), f AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'), m AS (SELECT c.event_id, c.ts, max(f.ts) FILTER (f.ts <= c.ts) AS known, min(f.ts) FILTER (f.ts >= c.ts) AS next FROM c LEFT JOIN f USING (user_id) GROUP BY 1, 2)
SELECT 'causal' AS selector, count(known) AS used, count(*) FILTER (known > ts) AS violations FROM m UNION ALL SELECT 'leaky', count(next), count(*) FILTER (next > ts) FROM m""")
def availability_guard(spark, sf_dir):
    """A selector may use only what was there at the decision: the backward join never breaks that, one that looks ahead
    is caught."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    asks, facts = e.filter("event_type = 'click'").select("event_id", "user_id", "us"), e.filter("event_type = 'purchase'").select("user_id", "us", F.col("us").alias("at"))
    each = [asof.availability_faults(asof.asof_join(asks, facts, ["user_id"], "us", "us", ["at"], forward=ahead), "us", "at").select(F.lit(name).alias("selector"), "used", "violations") for name, ahead in (("causal", False), ("leaky", True))]
    return each[0].unionByName(each[1])


@query("SELECT conv_id, turn, CAST(1 AS BIGINT) AS written FROM conversations")
def resumed_shards(spark, sf_dir):
    """Turns written to shards in two runs, the first of assistants only: the second writes what is missing."""
    path = fresh_path(spark, "shards")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    sinks.write_remaining(t.filter("role = 'assistant'"), path, "key", 4)
    sinks.write_remaining(t, path, "key", 4)
    return spark.read.parquet(path).groupBy("conv_id", "turn").agg(F.count("*").alias("written"))
