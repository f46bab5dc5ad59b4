"""Queries on mined outcomes, prefix packing, running scorers, hierarchical bootstraps, pairs, perturbations and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from decisa.functions import text
from decisa.operators import corpus, miners, removal, requests, resample, scorer
from decisa.plans.base import PANEL, SCORED, panel, query, rounded, scored, table
from decisa.plans.record_queries import DAILY, SEG, TURNS, _bodies, _turns
from decisa.session import fresh_path, materialize
from decisa.streaming import counters, daybook


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, i, CASE role WHEN 'user' THEN 'user_turn' WHEN 'assistant' THEN 'assistant_text' ELSE 'tool_result' END AS kind, text || ' https://x.org/' || (length(text) % 5) || '/abcdefgh, ' || substring(md5(CAST(i // 3 AS VARCHAR)), 1, 12) AS text FROM turns),
u AS (SELECT conv_id, i, kind, 0 AS rank, 'url' AS k, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\\s<>"'')]+')), '[.,;]+$', '') AS unit FROM s
  UNION SELECT conv_id, i, kind, CASE WHEN length(h) >= 10 THEN 0 ELSE 1 END, CASE WHEN length(h) >= 10 THEN 'hash' ELSE 'short_hash' END, h FROM (SELECT conv_id, i, kind, unnest(regexp_extract_all(text, '[0-9a-f]{{12}}$')) AS h FROM s)
  WHERE regexp_matches(h, '[0-9]')),
w AS (SELECT conv_id, i, kind, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM s WHERE kind IN ('user_turn', 'assistant_text')),
p AS (SELECT conv_id, i, kind, unnest(list_transform(range(1, len(w) - 4), lambda j: w[j:j+5])) AS r FROM w WHERE len(w) >= 6),
v AS (SELECT * FROM u UNION SELECT conv_id, i, kind, 0, 'phrase', array_to_string(r, ' ') FROM p WHERE len(list_filter(r, lambda x: length(x) >= 5)) > 0),
n AS (SELECT *, min(i) FILTER (kind IN ('assistant_text', 'user_turn')) OVER (PARTITION BY conv_id, k, unit ORDER BY i RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS usage FROM v),
b AS (SELECT conv_id, i, kind, min(struct_pack(a := rank, b := usage, c := k, d := unit)) AS l FROM n WHERE usage IS NOT NULL AND kind IN ('tool_result', 'user_turn') GROUP BY 1, 2, 3),
z AS (SELECT conv_id, i, kind, octet_length(encode(text)) AS size, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) FILTER (kind = 'user_turn') OVER (PARTITION BY conv_id ORDER BY i) AS anchor FROM s),
f AS (SELECT b.*, y.anchor, y.upto - y.size - greatest(1500 - y.size - o.size - CASE WHEN y.anchor IN (y.i, b.i) THEN 0 ELSE a.size END, 0) AS floor FROM b JOIN z y ON y.conv_id = b.conv_id AND y.i = l.b JOIN z o ON o.conv_id = b.conv_id AND o.i = b.i JOIN z a ON a.conv_id = b.conv_id AND a.i = y.anchor)
SELECT f.conv_id, f.i AS place, CASE WHEN f.kind = 'user_turn' THEN 'user_requirement_echo' ELSE 'command_output_echo' END AS strategy, 'keep' AS label, CASE l.a WHEN 0 THEN 'strong' ELSE 'medium' END AS strength, l.c AS unit_kind, md5(l.d) AS unit, l.b AS usage, f.anchor,
  least(l.b, (SELECT min(z.i) FROM z WHERE z.conv_id = f.conv_id AND z.upto - z.size >= f.floor)) AS first FROM f WHERE f.anchor <> f.i""")
def mined_outcomes(spark, sf_dir):
    """Turns that later ones used, by URLs, hashes and phrases, and where the window of 1,500 bytes begins. Rare names
    are left to the tests."""
    t = _turns(spark, sf_dir)
    kind = F.when(F.col("role") == "user", "user_turn").when(F.col("role") == "assistant", "assistant_text").otherwise("tool_result")
    more = F.concat("text", F.lit(" https://x.org/"), F.length("text") % 5, F.lit("/abcdefgh, "), F.substring(F.md5(F.floor(F.col("i") / 3).cast("string").cast("binary")), 1, 12))
    s = t.select("conv_id", F.col("i").cast("long").alias("place"), kind.alias("kind"), more.alias("text"))
    units = miners.evidence_units(s, "conv_id").filter("unit_kind in ('url', 'phrase') or unit_kind = 'hash' and length(unit) = 12")
    found = miners.outcome_windows(s, miners.first_uses(units, "conv_id"), "conv_id", 1500).filter("anchor <> place")
    strategy = F.when(F.col("of") == "user_turn", "user_requirement_echo").otherwise("command_output_echo")
    return found.select("conv_id", "place", strategy.alias("strategy"), F.lit("keep").alias("label"), "strength", "unit_kind", F.md5(F.col("unit").cast("binary")).alias("unit"), "usage", "anchor", "first")


@query("""WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce(list_transform(string_split(substring(text, 1, 200), ' '), lambda x: length(x)), []) AS t FROM documents),
o AS (SELECT doc_id, lang, t, row_number() OVER (PARTITION BY lang ORDER BY t, doc_id) AS k FROM d),
m AS (SELECT o.*, (k - 1) // 64 AS block, (k - 1) % 64 AS j, lag(t) OVER (PARTITION BY lang, (k - 1) // 64 ORDER BY k) AS before FROM o),
s AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(range(1, least(len(t), len(before)) + 1), lambda n: t[1:n] = before[1:n])) END AS same FROM m),
r(lang, block, j, doc_id, "row", used, shared, cost) AS (
  SELECT lang, block, j, doc_id, 0, len(t), 0, len(t) FROM s WHERE j = 0
  UNION ALL SELECT s.lang, s.block, s.j, s.doc_id, CASE WHEN r.used + len(s.t) - s.same > 120 THEN r."row" + 1 ELSE r."row" END, CASE WHEN r.used + len(s.t) - s.same > 120 THEN len(s.t) ELSE r.used + len(s.t) - s.same END,
    CASE WHEN r.used + len(s.t) - s.same > 120 THEN 0 ELSE s.same END, CASE WHEN r.used + len(s.t) - s.same > 120 THEN len(s.t) ELSE len(s.t) - s.same END
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang AND s.block = r.block AND s.j = r.j + 1)
SELECT lang, doc_id AS id, CAST(block AS BIGINT) AS block, CAST("row" AS BIGINT) AS "row", CAST(shared AS BIGINT) AS shared, CAST(cost AS BIGINT) AS cost FROM r""")
def prefix_packing(spark, sf_dir):
    """Lengths of each document's first words as token arrays, packed into rows of 120 in which a prefix counts once."""
    words = F.transform(F.split(F.substring("text", 1, 200), " "), lambda w: F.length(w).cast("long"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("tokens"))
    return removal.pack_prefixes(d, "lang", "doc_id", "tokens", 120, 64)


WEIGHTS = (-3.0, 0.7, 5.0, -8.0)


@query(f"""WITH {SEG}, c AS (SELECT conv_id, pointer, length(text) AS n, text FROM seg WHERE role = 'assistant'),
p AS (SELECT conv_id, pointer, 1 / (1 + exp(-(-3.0::DOUBLE + 0.7::DOUBLE * ln(1 + n) + 5.0::DOUBLE * length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(n, 1) - 8.0::DOUBLE * length(regexp_replace(text, '[^?]', '', 'g')) / greatest(n, 1)))) AS p FROM c),
g AS (SELECT conv_id, count(*) AS n, sum(p) AS p FROM p GROUP BY 1)
SELECT conv_id, CASE conv_id % 7 WHEN 1 THEN 'wrong_ids' WHEN 2 THEN 'wrong_sum' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'scorer_error' END AS reason, CASE WHEN conv_id % 7 IN (1, 2, 3, 4) THEN 0 ELSE n END AS scored, CASE WHEN conv_id % 7 NOT IN (1, 2, 3, 4) THEN round(p, 6) END AS total FROM g""")
def running_scorer(spark, sf_dir):
    """A logistic scorer's answers for the assistant's segments of all requests; in some the answer is spoilt by the
    request's key, and only these lose their scores."""
    s = requests.wire_segments(requests.parsed_requests(_bodies(spark, sf_dir), "conv_id", "raw", "wire"), "conv_id").filter("role = 'assistant'")
    s = s.withColumn("id", F.concat_ws(":", "conv_id", "pointer"))
    build = scorer.logistic_scorer(list(WEIGHTS))

    def spoilt():
        score = build()

        def run(ids, texts):
            answers, fault = score(ids, texts), int(ids[0].split(":")[0]) % 7
            if fault == 4:
                raise RuntimeError("no answer")
            if fault == 1:
                answers["more"] = {"false": 0.5, "true": 0.5}
            if fault in (2, 3):
                answers[ids[-1]]["true"] = float("nan") if fault == 3 else answers[ids[-1]]["true"] / 2
            return answers

        return run

    a = scorer.answered(s, "conv_id", "id", "text", spoilt)
    total = F.aggregate("scores", F.lit(0.0), lambda n, x: n + x["p"])
    return rounded(a.select("conv_id", "reason", F.size("scores").cast("long").alias("scored"), F.when(F.col("reason").isNull(), total).alias("total")))


ARMS = """a AS (SELECT CASE id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS arm, (id // 3) % 4 AS seed, (id // 12) % 6 AS grp, correct::INT::DOUBLE AS v FROM scored),
g AS (SELECT arm, seed, grp, sum(v) AS s, count(v) AS n FROM a GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY arm, seed ORDER BY grp) AS i, count(*) OVER (PARTITION BY arm, seed) AS m FROM g),
e AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY seed) AS i, count(*) OVER (PARTITION BY arm) AS k FROM (SELECT DISTINCT arm, seed, m FROM h)),
d1 AS (SELECT b AS sample, arm, 1 + CAST('0x' || substring(sha256('x|' || b || '|' || arm || '|' || j), 1, 8) AS BIGINT) % k AS i FROM (SELECT DISTINCT arm, k FROM e), range(40) t(b), range(1, 20) u(j) WHERE j <= k),
f1 AS (SELECT sample, e.arm, e.seed, any_value(m) AS m, count(*) AS k FROM d1 JOIN e ON e.arm = d1.arm AND e.i = d1.i GROUP BY ALL),
d2 AS (SELECT sample, arm, seed, k, 1 + CAST('0x' || substring(sha256('x|' || sample || '|' || arm || '|' || seed || '|' || j), 1, 8) AS BIGINT) % m AS i FROM f1, range(1, 20) u(j) WHERE j <= m),
w AS (SELECT sample, arm, seed, i, count(*) * any_value(k) AS w FROM d2 GROUP BY 1, 2, 3, 4),
means AS (SELECT sample, w.arm, sum(w * s) / sum(w * n) AS mean FROM w JOIN h ON h.arm = w.arm AND h.seed = w.seed AND h.i = w.i GROUP BY 1, 2)"""
CONTRASTS = {"two_less_one": {"two": 1.0, "one": -1.0}, "three_less_both": {"three": 1.0, "one": -0.5, "two": -0.5}}


def _means(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("arm", F.when(F.col("id") % 3 == 0, "one").when(F.col("id") % 3 == 1, "two").otherwise("three"))
    s = s.withColumns({"seed": F.floor(F.col("id") / 3) % 4, "cluster": F.floor(F.col("id") / 12) % 6})
    return resample.hierarchical_bootstrap(s, "arm", "seed", "cluster", F.col("correct").cast("double"), 40, "x")


@query(f"WITH {SCORED}, {ARMS} SELECT sample, arm, round(mean, 6) AS mean FROM means")
def hierarchical_bootstrap(spark, sf_dir):
    """Accuracy of three arms under draws of seeds, and of groups within each drawn seed."""
    return rounded(_means(spark, sf_dir))


INTERVALS = """x AS (SELECT sample, max(mean) FILTER (arm = 'two') - max(mean) FILTER (arm = 'one') AS two_less_one, max(mean) FILTER (arm = 'three') - 0.5 * max(mean) FILTER (arm = 'one') - 0.5 * max(mean) FILTER (arm = 'two') AS three_less_both FROM means GROUP BY 1),
v AS (UNPIVOT x ON two_less_one, three_less_both INTO NAME contrast VALUE value),
l AS (SELECT contrast, count(*) AS samples, list_sort(list(value)) AS v FROM v GROUP BY 1),
ends AS (SELECT contrast, samples, v[1 + CAST(floor(0.025 * (samples - 1)) AS INT)] AS low, v[1 + CAST(ceil(0.975 * (samples - 1)) AS INT)] AS high FROM l)"""


@query(f"WITH {SCORED}, {ARMS}, {INTERVALS} SELECT contrast, samples, round(low, 6) AS low, round(high, 6) AS high FROM ends")
def bootstrap_contrasts(spark, sf_dir):
    """Intervals of linear contrasts between the arms."""
    return rounded(resample.contrasts(_means(spark, sf_dir), CONTRASTS))


@query(f"""WITH {SCORED}, {ARMS}, {INTERVALS} SELECT contrast, CASE WHEN samples < 30 THEN 'PENDING' WHEN low >= -0.1 THEN 'PASS' WHEN high < -0.1 THEN 'FAIL' ELSE 'UNDECIDED' END AS verdict FROM ends

UNION ALL SELECT arm, CASE WHEN v[1] >= 0.7 THEN 'PASS' WHEN v[40] < 0.7 THEN 'FAIL' ELSE 'UNDECIDED' END FROM (SELECT arm, list_sort(list(mean)) AS v FROM means GROUP BY 1)""")
def interval_gates(spark, sf_dir):
    """Gates decided by the ends of intervals: contrasts must not fall below -0.1, each arm's accuracy not below 0.7."""
    means = _means(spark, sf_dir)
    arms = resample.contrasts(means, {a: {a: 1.0} for a in ("one", "two", "three")}).withColumn("least", F.lit(0.7))
    c = resample.contrasts(means, CONTRASTS).withColumn("least", F.lit(-0.1)).unionByName(arms)
    verdict = F.when(F.col("samples") < 30, "PENDING").when(F.col("low") >= F.col("least"), "PASS").when(F.col("high") < F.col("least"), "FAIL").otherwise("UNDECIDED")
    return c.select("contrast", verdict.alias("verdict"))


@query("""WITH r AS (SELECT doc_id AS id, quality AS y, source, lang FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY source, lang, y ORDER BY id) AS k FROM r),
m AS (SELECT source, lang, k, max(id) FILTER (y = 1) AS positive, max(id) FILTER (y = 0) AS negative FROM p GROUP BY 1, 2, 3),
q AS (SELECT p.*, row_number() OVER (PARTITION BY source, y ORDER BY id) AS k2 FROM p WHERE id IN (SELECT coalesce(positive, negative) FROM m WHERE positive IS NULL OR negative IS NULL)),
n AS (SELECT source, k2, max(id) FILTER (y = 1) AS positive, max(id) FILTER (y = 0) AS negative FROM q GROUP BY 1, 2)
SELECT positive, negative, 1 AS passed FROM m WHERE positive IS NOT NULL AND negative IS NOT NULL UNION ALL SELECT positive, negative, 2 FROM n WHERE positive IS NOT NULL AND negative IS NOT NULL""")
def two_pass_pairs(spark, sf_dir):
    """Good and bad documents paired within source and language, then what is left within source."""
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return corpus.two_pass_pairs(r, "doc_id", "quality", ["source", "lang"], ["source"])


SPAN = "(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+|v?[0-9]+[.][0-9]+(?:[.][0-9]+)+|[0-9]+(?:[.][0-9]+)?"


@query(f"""WITH t AS (SELECT page_id, coalesce(url, '') || ' v1.2.' || page_id || ' and ' || page_id * 7 || ' of a/b.c' || page_id % 9 AS x, CAST('0x' || substring(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) AS draw FROM pages),
f AS (SELECT *, regexp_extract_all(x, '{SPAN}') AS f, string_split_regex(x, '{SPAN}') AS g FROM t), k AS (SELECT *, 1 + draw % len(f) AS k FROM f),
b AS (SELECT *, f[k] AS before, length(array_to_string(g[1:k], '')) + length(array_to_string(f[1:k-1], '')) AS start FROM k),
c AS (SELECT *, CASE WHEN contains(before, '/') THEN 'path' WHEN regexp_full_match(before, 'v?[0-9]+[.][0-9]+([.][0-9]+)+') THEN 'version' ELSE 'number' END AS kind FROM b),
d AS (SELECT *, CASE kind WHEN 'path' THEN regexp_extract(before, '^(.*/)', 1) || regexp_replace(regexp_extract(before, '([^/]*)$', 1), '^([^.]*)(.*)$', '\\1_x\\2') ELSE before[1:length(before)-1] || (CAST(before[length(before)] AS INT) + 1) % 10 END AS after FROM c)
SELECT page_id, kind, CAST(start AS BIGINT) AS start, before, after, x[1:start] || after || x[start + length(before) + 1:] AS text FROM d""")
def entity_perturbation(spark, sf_dir):
    """One path, version or number of each page's line changed, picked by a hash of its id."""
    i = F.col("page_id")
    x = F.concat(F.coalesce("url", F.lit("")), F.lit(" v1.2."), i, F.lit(" and "), i * 7, F.lit(" of a/b.c"), i % 9)
    draw = F.conv(F.substring(F.md5(i.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", text.perturbed(x, draw).alias("p")).select("page_id", "p.*")


CLOSED = DAILY.replace("panel AS (", "panel0 AS (", 1).replace(", k AS (", """, panel AS (SELECT * FROM panel0 WHERE dn < (SELECT greatest(min(m), max(m) - 3) FROM (SELECT max(dn) AS m FROM panel0 GROUP BY asset))), k AS (""", 1)


@query(f"""WITH {CLOSED}, l AS (SELECT d.dn, EXISTS (SELECT 1 FROM book b WHERE b.dn = d.dn) AS rebalanced, greatest(ins, outs) AS changed, greatest(ins, outs) / 4.0::DOUBLE * 5 AS cost, CASE WHEN coalesce(legs, 0) = 0 THEN 0 WHEN priced = legs THEN gross END AS gross FROM d JOIN c USING (dn) LEFT JOIN r USING (dn))
SELECT dn AS day, CASE WHEN rebalanced THEN 'rebalance' ELSE 'skipped_insufficient_universe' END AS event, CAST(changed AS BIGINT) AS changed, round(cost, 4) AS cost_bps, round(gross, 3) AS gross_bps, round(coalesce(sum(gross) OVER (ORDER BY dn), 0) - sum(cost) OVER (ORDER BY dn), 3) AS booked_bps FROM l""")
def closed_date_book(spark, sf_dir):
    """The daily book decided date by date as three micro-batches come in, in which some assets are up to two days late,
    and the second one twice; a date is closed when all have passed it, or three days after."""
    rows = panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), "close", (F.col("dn") + F.pmod("asset", F.lit(3))).alias("came"))
    ends = rows.agg(F.min("came").alias("low"), F.max("came").alias("high")).first()
    path = fresh_path(spark, "daybook")
    batch = F.least(F.floor((F.col("came") - ends["low"]) * 3 / (ends["high"] - ends["low"] + 1)), F.lit(2))
    for k in (0, 1, 1, 2):
        daybook.decide_closed(rows.filter(batch == k), k, path, 2, 6, 5.0, 3)
    out = spark.read.schema(daybook.LEDGER).parquet(f"{path}/ledger")
    return out.select("day", "event", "changed", F.round("cost_bps", 4).alias("cost_bps"), F.round("gross_bps", 3).alias("gross_bps"), F.round("booked_bps", 3).alias("booked_bps"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS second, value, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms FROM events),
w AS (SELECT *, count(*) OVER p AS orders, sum(abs(value)) OVER p AS turnover FROM e WINDOW p AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id AS id, second, orders, round(turnover, 4) AS turnover FROM w WHERE second < (SELECT (max(ms) - 3600000) // 1000 FROM e)""")
def expiring_counters(spark, sf_dir):
    """Events and turnover of the day before each event, counted by a stream whose state forgets; events within the last
    hour are still waiting."""
    e, source, out, cp = table(spark, sf_dir, "events"), *[fresh_path(spark, n) for n in ("events", "counters", "counters-log")]
    e = e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    told = counters.stream_counters(stream, "user_id", "event_id", "ts", "value", 86_400, "1 hour")
    told.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(told.schema).parquet(out)
    return rows.select("user_id", "id", "second", "orders", F.round("turnover", 4).alias("turnover"))


@query(f"""WITH {PANEL}, d AS (SELECT DISTINCT dn FROM panel) SELECT dn AS day, 'lost_date' AS issue FROM d WHERE dn % 11 = 3 UNION ALL SELECT dn, 'rewritten' FROM d WHERE dn % 11 = 5 UNION ALL SELECT dn, 'not_resummed' FROM d WHERE dn % 11 = 5""")
def saved_state_probe(spark, sf_dir):
    """A ledger of days probed twice: between, some dates are lost and some booked sums moved."""
    d = panel(spark, sf_dir).groupBy(F.col("dn").alias("day")).agg(F.round(F.avg("close"), 4).alias("g"))
    empty = F.col("day") % 11 == 3
    d = d.select("day", F.when(~empty, F.col("g")).alias("gross_bps"), F.when(empty, 0.0).otherwise(1.0).alias("cost_bps"))
    run = Window.orderBy("day")  # a row a day
    d = materialize(d.withColumn("booked_bps", F.coalesce(F.sum("gross_bps").over(run), F.lit(0.0)) - F.sum("cost_bps").over(run)), "ledger")
    state = fresh_path(spark, "probe-state")
    daybook.probe(d, state)
    moved = d.filter("day % 11 <> 3").withColumn("booked_bps", F.col("booked_bps") + F.when(F.col("day") % 11 == 5, 1.0).otherwise(0.0))
    return daybook.probe(moved, state).select("day", "issue")
