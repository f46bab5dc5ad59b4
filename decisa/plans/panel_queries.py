"""Panel queries on daily values of events: as-of and lagged joins, windows, legs, books and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from decisa.functions import stats, windows
from decisa.operators import asof, corpus, joins, panel as books
from decisa.plans.base import PANEL, panel, query, rounded, table

W = "PARTITION BY asset ORDER BY day"


@query(f"""WITH {PANEL}, r AS (
  SELECT *, CASE WHEN lead(dn) OVER ({W}) = dn + 1 AND close > 0 THEN lead(close) OVER ({W}) / close - 1 END AS fwd,
    list(fund) FILTER (fund IS NOT NULL) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM (
      SELECT asset, day, dn, close, last_value(fund IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fund FROM panel)
), s AS (
  SELECT *, CASE WHEN fund IS NOT NULL AND len(h) >= 3 THEN (len(list_filter(h, lambda v: v < fund)) + 0.5::DOUBLE * len(list_filter(h, lambda v: v = fund))) / len(h) END AS score FROM r
), k AS (
  SELECT *, count(*) OVER (PARTITION BY dn) AS n, row_number() OVER (PARTITION BY dn ORDER BY score, asset) AS k FROM s WHERE score IS NOT NULL AND fwd IS NOT NULL
), b AS (
  SELECT *, CASE WHEN k <= greatest(1, n // 10) THEN 'short' WHEN k > n - greatest(1, n // 10) THEN 'long' END AS leg FROM k WHERE n >= 8
), e AS (
  SELECT *, min(score) FILTER (leg = 'long') OVER (PARTITION BY dn) > max(score) FILTER (leg = 'short') OVER (PARTITION BY dn) AS fine FROM b
)
SELECT dn AS day, round(avg(fwd) FILTER (leg = 'long') - avg(fwd) FILTER (leg = 'short'), 6) AS spread, count(*) AS names
FROM e WHERE fine AND leg IS NOT NULL GROUP BY dn""")
def pit_asof_decile_spread(spark, sf_dir):
    """Latest purchase value as of each day, its trailing mid-rank, decile legs and the spread of next-day returns."""
    p = panel(spark, sf_dir)
    facts = p.filter("fund is not null").select("asset", "dn", F.col("fund").alias("settled"))
    rows = asof.asof_join(p.select("asset", "day", "dn", "close"), facts, ["asset"], "dn", "dn", ["settled"])
    rows = rows.withColumn("fwd", windows.relative(windows.contiguous_lead("asset", "day", "close", 1), F.col("close")))
    rows = windows.trailing_mid_rank(rows, "asset", "dn", "settled", 10, 3, "score").filter("fwd is not null")
    book = books.legs(rows, "dn", "asset", "score", least=8)
    return rounded(books.leg_spread(book, "dn", "fwd").withColumnRenamed("dn", "day"))


EVENTS = """c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), f AS (SELECT event_id AS fid, user_id, ts, value FROM events WHERE event_type = 'purchase')"""


def _asof_sql(op: str, pick: str, order: str) -> str:
    return f"""WITH {EVENTS}, m AS (SELECT c.event_id, {pick}(f.value, struct_pack(a := f.ts, b := {order})) AS v FROM c LEFT JOIN f ON c.user_id = f.user_id AND f.ts {op} c.ts GROUP BY c.event_id)
SELECT event_id, round(v, 6) AS ref FROM m"""


def _asof_events(spark, sf_dir, **how):
    e = table(spark, sf_dir, "events")
    asks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    facts = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("ref"))
    return rounded(asof.asof_join(asks, facts, ["user_id"], "ts", "ts", ["ref"], tie=["event_id"], **how).select("event_id", "ref"))


@query(_asof_sql("<=", "arg_max", "f.fid"))
def asof_backward_inclusive(spark, sf_dir):
    return _asof_events(spark, sf_dir)


@query(_asof_sql("<", "arg_max", "f.fid"))
def asof_backward_strict(spark, sf_dir):
    return _asof_events(spark, sf_dir, strict=True)


@query(f"""WITH {EVENTS}, m AS (SELECT c.event_id, max(f.ts) AS ts FROM c LEFT JOIN f ON c.user_id = f.user_id AND f.ts <= c.ts GROUP BY 1)
SELECT c.event_id, CASE WHEN m.ts IS NULL THEN NULL ELSE epoch_us(c.ts) - epoch_us(m.ts) END AS age_us FROM c JOIN m USING (event_id)""")
def asof_age_bucketed(spark, sf_dir):
    """The same join with each key's time cut into buckets of a week, so a hot key spreads over tasks."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    asks = e.filter("event_type = 'click'").select("event_id", "user_id", "us")
    facts = e.filter("event_type = 'purchase'").select("user_id", F.col("us"), F.col("us").alias("settled"), "event_id")
    out = asof.asof_join(asks, facts, ["user_id"], "us", "us", ["settled"], tie=["event_id"], bucket=7 * 86_400_000_000)
    return out.select("event_id", (F.col("us") - F.col("settled")).alias("age_us"))


@query(f"""WITH {EVENTS}, m AS (SELECT c.event_id, min(f.ts) AS ts FROM c LEFT JOIN f ON c.user_id = f.user_id AND f.ts >= c.ts GROUP BY 1)
SELECT c.event_id, round((epoch_us(m.ts) - epoch_us(c.ts)) / 3600000000.0::DOUBLE, 6) AS hours FROM c JOIN m USING (event_id)""")
def asof_forward_hours(spark, sf_dir):
    """Hours to the next purchase."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    asks = e.filter("event_type = 'click'").select("event_id", "user_id", "us")
    facts = e.filter("event_type = 'purchase'").select("user_id", "us", F.col("us").alias("next"))
    out = asof.asof_join(asks, facts, ["user_id"], "us", "us", ["next"], forward=True)
    return rounded(out.select("event_id", ((F.col("next") - F.col("us")) / 3.6e9).alias("hours")))


@query(f"""WITH {PANEL}, m AS (SELECT a.asset, a.dn, arg_max(b.close, b.dn) AS old FROM panel a LEFT JOIN panel b ON a.asset = b.asset AND b.dn < a.dn - 1 GROUP BY 1, 2)
SELECT p.asset, p.dn AS day, round(CASE WHEN p.close > 0 AND m.old > 0 THEN ln(p.close / m.old) END, 6) AS log_ratio FROM panel p JOIN m USING (asset, dn)""")
def asof_offset_log_ratio(spark, sf_dir):
    """Log ratio to the last value strictly before one day earlier."""
    p = panel(spark, sf_dir)
    asks = p.select("asset", "dn", "close", (F.col("dn") - 1).alias("at"))
    out = asof.asof_join(asks, p.select("asset", "dn", F.col("close").alias("old")), ["asset"], "at", "dn", ["old"], strict=True)
    return rounded(out.select("asset", F.col("dn").alias("day"), windows.log_ratio(F.col("close"), F.col("old")).alias("log_ratio")))


@query(f"""WITH {PANEL}, g AS (SELECT asset, d AS dn FROM (SELECT DISTINCT asset FROM panel), (SELECT DISTINCT dn AS d FROM panel)),
m AS (SELECT g.asset, g.dn, arg_max(p.close, p.dn) AS close, max(p.dn) AS as_of FROM g LEFT JOIN panel p ON p.asset = g.asset AND p.dn <= g.dn GROUP BY 1, 2)
SELECT asset, dn AS day, round(close, 6) AS close, coalesce(as_of <> dn, true) AS stale FROM m""")
def carry_forward_stale(spark, sf_dir):
    """Every asset on every day with its last close, flagged stale when carried over."""
    p = panel(spark, sf_dir)
    days = p.agg(F.collect_set("dn").alias("days"))
    grid = p.select("asset").distinct().join(F.broadcast(days)).select("asset", F.explode("days").alias("dn"))
    out = asof.carry_forward(grid, p.select("asset", "dn", "close"), ["asset"], "dn", "dn", "close")
    return rounded(out.select("asset", F.col("dn").alias("day"), "close", "stale"))


@query(f"""WITH {PANEL} SELECT a.asset, a.dn AS day, round(a.close, 6) AS close, round(b.close, 6) AS later FROM panel a JOIN panel b ON a.asset = b.asset AND b.dn = a.dn + 2""")
def lead_lag_pairs(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = joins.lagged_join(p.select("asset", "dn", "close"), p, ["asset"], "dn", 2, "close", "later")
    return rounded(out.select("asset", F.col("dn").alias("day"), "close", "later"))


@query(f"""WITH {PANEL} SELECT a.asset, a.dn AS day, round(b.close, 6) AS ahead, round(c.close, 6) AS behind FROM panel a LEFT JOIN panel b ON a.asset = b.asset AND b.dn = a.dn + 5 LEFT JOIN panel c ON a.asset = c.asset AND c.dn = a.dn - 5""")
def calendar_self_join(spark, sf_dir):
    p = panel(spark, sf_dir)
    out = joins.calendar_shift(p.select("asset", "day", "dn"), p, ["asset"], "day", 5, "close", "ahead")
    out = joins.calendar_shift(out, p, ["asset"], "day", -5, "close", "behind")
    return rounded(out.select("asset", F.col("dn").alias("day"), "ahead", "behind"))


@query(f"""WITH {PANEL}, k AS (SELECT *, event_type FROM (SELECT user_id AS asset, CAST(ts AS DATE) AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3))
SELECT a.asset, datediff('day', DATE '1970-01-01', a.day) AS day, round(a.v, 6) AS clicks, round(b.v, 6) AS views, round(c.v, 6) AS buys FROM k a JOIN k b USING (asset, day) JOIN k c USING (asset, day)
WHERE a.event_type = 'click' AND b.event_type = 'view' AND c.event_type = 'purchase'""")
def series_intersection(spark, sf_dir):
    """Three keyed series on their common keys."""
    e = table(spark, sf_dir, "events")
    k = e.groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("v"))
    of = lambda kind, name: k.filter(F.col("event_type") == kind).select("asset", "day", F.col("v").alias(name))
    out = of("click", "clicks").join(of("view", "views"), ["asset", "day"]).join(of("purchase", "buys"), ["asset", "day"])
    return rounded(out.select("asset", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day"), "clicks", "views", "buys"))


def _mid_rank_sql(frame: str, source: str = "panel", least: int = 3, x: str = "fund") -> str:
    return f"""WITH {PANEL}, h AS (SELECT asset, dn, {x} AS x, list({x}) FILTER ({x} IS NOT NULL) OVER ({frame}) AS h FROM {source})
SELECT asset, dn AS day, round(CASE WHEN x IS NOT NULL AND len(h) >= {least} THEN (len(list_filter(h, lambda v: v < x)) + 0.5::DOUBLE * len(list_filter(h, lambda v: v = x))) / len(h) END, 6) AS pct FROM h"""


@query(_mid_rank_sql(f"{W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"))
def mid_rank_of_records(spark, sf_dir):
    out = windows.trailing_mid_rank(panel(spark, sf_dir), "asset", "dn", "fund", 10, 3, "pct")
    return rounded(out.select("asset", F.col("dn").alias("day"), "pct"))


@query(_mid_rank_sql(f"{W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING", "(SELECT * FROM panel WHERE fund IS NOT NULL)") + f" UNION ALL SELECT asset, dn, NULL FROM panel WHERE fund IS NULL")
def mid_rank_of_numbers(spark, sf_dir):
    out = windows.trailing_mid_rank_non_null(panel(spark, sf_dir), "asset", "dn", "fund", 10, 3, "pct")
    return rounded(out.select("asset", F.col("dn").alias("day"), "pct"))


@query(_mid_rank_sql("PARTITION BY asset ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING", x="close"))
def mid_rank_of_days(spark, sf_dir):
    out = windows.trailing_mid_rank_range(panel(spark, sf_dir), "asset", "dn", "close", 7, 3, "pct")
    return rounded(out.select("asset", F.col("dn").alias("day"), "pct"))


@query(f"""WITH {PANEL} SELECT asset, dn AS day, round(CASE WHEN fund IS NOT NULL THEN (rank() OVER (PARTITION BY dn ORDER BY fund NULLS LAST) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY dn, fund)) / count(fund) OVER (PARTITION BY dn) END, 6) AS pct FROM panel""")
def cross_section_rank(spark, sf_dir):
    out = windows.cross_section_mid_rank(panel(spark, sf_dir), "dn", "fund", "pct")
    return rounded(out.select("asset", F.col("dn").alias("day"), "pct"))


@query(f"""WITH {PANEL}, w AS (SELECT *, avg(close) OVER b AS m, stddev_pop(close) OVER b AS sd FROM panel WINDOW b AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT asset, dn AS day, round(CASE WHEN sd > 0 THEN (close - m) / sd WHEN sd = 0 THEN 0 END, 6) AS z FROM w""")
def trailing_z_score(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), windows.trailing_z("asset", "day", "close", 10).alias("z")))


@query(f"""WITH {PANEL}, r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) END AS r FROM panel)
SELECT asset, dn AS day, round(CASE WHEN count(r) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END, 6) AS vol FROM r""")
def realized_volatility(spark, sf_dir):
    out = windows.realized_volatility(panel(spark, sf_dir), "asset", "dn", "close", 6, "vol")
    return rounded(out.select("asset", F.col("dn").alias("day"), "vol"))


@query(f"""WITH {PANEL} SELECT asset, dn AS day, round(CASE WHEN dn - lag(dn, 5) OVER ({W}) = 5 AND max(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) > 0 THEN close / max(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - 1 END, 6) AS dfh,
round(CASE WHEN dn - lag(dn, 4) OVER ({W}) = 4 THEN avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS sma FROM panel""")
def high_distance_and_average(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), windows.distance_from_high("asset", "day", "close", 5).alias("dfh"), windows.moving_average("asset", "day", "close", 5).alias("sma")))


@query(f"""WITH {PANEL} SELECT asset, dn AS day, round(CASE WHEN dn - lag(dn, 5) OVER ({W}) = 5 AND lag(close, 5) OVER ({W}) > 0 THEN close / lag(close, 5) OVER ({W}) - 1 END, 6) AS momentum,
round(CASE WHEN lead(dn) OVER ({W}) - dn = 1 AND close > 0 THEN lead(close) OVER ({W}) / close - 1 END, 6) AS fwd1, round(CASE WHEN lead(dn, 5) OVER ({W}) - dn = 5 AND close > 0 THEN lead(close, 5) OVER ({W}) / close - 1 END, 6) AS fwd5 FROM panel""")
def momentum_and_labels(spark, sf_dir):
    p = panel(spark, sf_dir)
    c = F.col("close")
    return rounded(p.select("asset", F.col("dn").alias("day"), windows.relative(c, windows.contiguous_lag("asset", "day", "close", 5)).alias("momentum"), windows.relative(windows.contiguous_lead("asset", "day", "close", 1), c).alias("fwd1"), windows.relative(windows.contiguous_lead("asset", "day", "close", 5), c).alias("fwd5")))


@query(f"""WITH {PANEL}, h AS (SELECT *, list_sort(list(fund) FILTER (fund IS NOT NULL) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS h FROM panel)
SELECT asset, dn AS day, round(CASE WHEN len(h) >= 3 THEN list_median(h) END, 6) AS med FROM (SELECT * REPLACE (h AS h) FROM h)""".replace("list_median(h)", "list_aggregate(h, 'median')"))
def trailing_median(spark, sf_dir):
    return rounded(panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), windows.trailing_median("asset", "day", "fund", 10, 3).alias("med")))


ATR = """WITH RECURSIVE d AS (SELECT user_id AS asset, CAST(ts AS DATE) AS day, max(value) AS hi, min(value) AS lo, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2),
t AS (SELECT asset, day, row_number() OVER w - 1 AS k, greatest(hi - lo, abs(hi - lag(close) OVER w), abs(lo - lag(close) OVER w)) AS tr FROM d WINDOW w AS (PARTITION BY asset ORDER BY day)),
r(asset, k, atr) AS (SELECT asset, 5, avg(tr) FROM t WHERE k BETWEEN 1 AND 5 GROUP BY asset HAVING count(*) = 5
  UNION ALL SELECT r.asset, t.k, (r.atr * 4 + t.tr) / 5 FROM r JOIN t ON t.asset = r.asset AND t.k = r.k + 1)
SELECT t.asset, datediff('day', DATE '1970-01-01', t.day) AS day, round(r.atr, 6) AS atr FROM t LEFT JOIN r USING (asset, k)"""


@query(ATR)
def wilder_atr(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("day")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    out = windows.wilder_atr(e, "asset", "day", "hi", "lo", "close", 5, "atr")
    return rounded(out.select("asset", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day"), "atr"))


@query(f"""WITH {PANEL}, f AS (SELECT *, fund IS NOT NULL AS hit FROM panel), g AS (SELECT *, dn - row_number() OVER (PARTITION BY asset, hit ORDER BY dn) AS island FROM f)
SELECT asset, dn AS day, CASE WHEN hit THEN row_number() OVER (PARTITION BY asset, hit, island ORDER BY dn) ELSE 0 END AS streak, coalesce(bool_or(hit) OVER (PARTITION BY asset ORDER BY dn RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS recent FROM g""")
def streaks_and_recent_flags(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("hit", F.col("fund").isNotNull())
    out = windows.streak(p, "asset", "day", "hit", "streak")
    return out.select("asset", F.col("dn").alias("day"), "streak", windows.recent_flag("asset", "dn", "hit", 3).alias("recent"))


@query(f"""WITH {PANEL} SELECT asset, dn AS day, round(CASE WHEN close > 0 THEN min(close) OVER f / close - 1 END, 6) AS mae, round(CASE WHEN close > 0 THEN max(close) OVER f / close - 1 END, 6) AS mfe FROM panel WINDOW f AS (PARTITION BY asset ORDER BY dn RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def forward_extremes(spark, sf_dir):
    low, high = windows.forward_extremes("asset", "dn", "close", 5)
    return rounded(panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), low.alias("mae"), high.alias("mfe")))


@query(f"""WITH {PANEL}, s AS (SELECT asset, dn, avg(CASE WHEN close > 50 THEN 1.0 ELSE 0.0 END) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS share FROM panel)
SELECT asset, dn AS day, round(share, 6) AS share, CASE WHEN share >= 0.6 THEN 'pos' WHEN share < 0.4 THEN 'neg' WHEN share IS NOT NULL THEN 'mix' END AS regime FROM s""")
def sliding_share_regime(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("above", F.col("close") - 50)
    out = p.select("asset", F.col("dn").alias("day"), windows.positive_share("asset", "day", "above", 10).alias("share"))
    return rounded(out.withColumn("regime", F.when(F.col("share") >= 0.6, "pos").when(F.col("share") < 0.4, "neg").when(F.col("share").isNotNull(), "mix")))


GAPS = """g AS (SELECT user_id AS asset, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), h AS (SELECT asset, s, round_even((s - lag(s) OVER (PARTITION BY asset ORDER BY s)) / 3600.0::DOUBLE, 0) AS r FROM g),
k AS (SELECT asset, s, CASE WHEN r > 0 AND r <= 48 THEN r END AS gap FROM h)"""


@query(f"""WITH {GAPS}, n AS (SELECT asset, gap, count(*) AS n FROM k WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT asset, CASE WHEN max(n) / sum(n) >= 0.2 THEN CAST(CAST(arg_max(gap, struct_pack(a := n, b := -gap)) AS INT) AS VARCHAR) ELSE 'mixed' END AS cadence, round(max(n) / sum(n), 6) AS share FROM n GROUP BY asset""")
def gap_cadence(spark, sf_dir):
    """Rounded hours between a user's events, and each user's dominant gap."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return rounded(windows.dominant(e.withColumn("gap", windows.gap_hours("asset", "s")), "asset", "gap", 0.2))


@query(f"""WITH {PANEL}, m AS (SELECT asset, dn, close - 50 AS v FROM panel), c AS (SELECT asset, dn, sum(v) OVER ({W.replace('day', 'dn')}) AS cum FROM m)
SELECT asset, dn AS day, round(cum, 6) AS cum, round(greatest(max(cum) OVER (PARTITION BY asset ORDER BY dn), 0) - cum, 6) AS dd0, round(max(cum) OVER (PARTITION BY asset ORDER BY dn) - cum, 6) AS dd_first FROM c""")
def cumulative_and_drawdown(spark, sf_dir):
    p = panel(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("dn").rowsBetween(Window.unboundedPreceding, 0)
    c = p.select("asset", "dn", F.sum(F.col("close") - 50).over(w).alias("cum"))
    c = stats.drawdown(stats.drawdown(c, "asset", "dn", "cum", 0.0, "dd0"), "asset", "dn", "cum", None, "dd_first")
    return rounded(c.withColumnRenamed("dn", "day"))


BOOK = f"""{PANEL}, k AS (SELECT asset, dn, close, count(*) OVER (PARTITION BY dn) AS n, row_number() OVER (PARTITION BY dn ORDER BY close, asset) AS k FROM panel),
b AS (SELECT dn, asset, close, CASE WHEN k <= greatest(1, n // 10) THEN 'short' WHEN k > n - greatest(1, n // 10) THEN 'long' END AS leg FROM k WHERE n >= 8),
book AS (SELECT dn, asset, leg FROM (SELECT *, min(close) FILTER (leg = 'long') OVER (PARTITION BY dn) > max(close) FILTER (leg = 'short') OVER (PARTITION BY dn) AS fine FROM b) WHERE fine AND leg IS NOT NULL)"""


def _book(spark, sf_dir):
    return books.legs(panel(spark, sf_dir), "dn", "asset", "close", least=8).select("dn", "asset", "leg")


@query(f"""WITH {BOOK} SELECT dn AS day, asset, leg FROM book""")
def decile_legs(spark, sf_dir):
    return _book(spark, sf_dir).withColumnRenamed("dn", "day")


@query(f"""WITH {BOOK}, d AS (SELECT dn, dense_rank() OVER (ORDER BY dn) AS i FROM (SELECT DISTINCT dn FROM book)), s AS (SELECT i, dn, leg, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY dn, leg) AS w FROM book JOIN d USING (dn)),
p AS (SELECT coalesce(a.i, b.i + 1) AS i, (a.asset IS NOT NULL)::INT AS cur, (b.asset IS NOT NULL)::INT AS prev, coalesce(a.w, 0) AS wa, coalesce(b.w, 0) AS wb FROM s a FULL JOIN s b ON a.i = b.i + 1 AND a.leg = b.leg AND a.asset = b.asset),
t AS (SELECT i, sum(cur * (1 - prev)) AS ins, sum(prev * (1 - cur)) AS outs, sum(cur) AS cur, sum(prev) AS prev, sum(abs(wa - wb)) / 2 AS weights FROM p GROUP BY i)
SELECT dn AS day, round(CASE WHEN i = 1 THEN 1 ELSE (ins + outs) / (2.0 * greatest(cur, prev)) END, 6) AS slots, round(CASE WHEN i = 1 THEN 1 ELSE greatest(ins, outs) / 4.0 END, 6) AS quarters, round(weights, 6) AS weights FROM t JOIN d USING (i)""")
def book_turnover(spark, sf_dir):
    return rounded(books.turnover(_book(spark, sf_dir), "dn", "asset").withColumnRenamed("dn", "day"))


@query(f"""WITH {BOOK}, d AS (SELECT dn, dense_rank() OVER (ORDER BY dn) AS i FROM (SELECT DISTINCT dn FROM book)), s AS (SELECT i, leg, asset, 1.0::DOUBLE / count(*) OVER (PARTITION BY i, leg) AS w FROM book JOIN d USING (dn)),
m AS (SELECT d.dn, s.leg, s.asset, sum(s.w) AS w FROM s JOIN d ON d.i BETWEEN s.i AND s.i + 2 GROUP BY 1, 2, 3)
SELECT dn AS day, leg, asset, round(w / sum(w) OVER (PARTITION BY dn, leg), 6) AS weight FROM m""")
def tranche_book(spark, sf_dir):
    return rounded(books.tranches(_book(spark, sf_dir), "dn", "asset", 3).withColumnRenamed("dn", "day"))


@query(f"""WITH {PANEL} SELECT asset, dn AS day, CAST(dn - min(dn) OVER (PARTITION BY asset) AS INT) AS age, min(dn) OVER (PARTITION BY asset) = min(dn) OVER () AS censored FROM panel""")
def first_seen_age(spark, sf_dir):
    p = panel(spark, sf_dir)
    start = p.agg(F.min("dn").alias("start"))
    first = F.min("dn").over(Window.partitionBy("asset"))
    return p.join(F.broadcast(start)).select("asset", F.col("dn").alias("day"), (F.col("dn") - first).alias("age"), (first == F.col("start")).alias("censored"))


@query(f"""WITH {PANEL}, e AS (SELECT a.asset, a.dn, a.close, list_sort(list(b.close)) AS h FROM panel a JOIN panel b ON a.asset = b.asset AND b.dn < a.dn GROUP BY 1, 2, 3)
SELECT p.asset, p.dn AS day, CASE WHEN len(h) >= 5 THEN p.close > list_aggregate(h, 'quantile_cont', 0.8) END AS above FROM panel p LEFT JOIN e USING (asset, dn)""")
def expanding_quantile_mask(spark, sf_dir):
    out = windows.expanding_quantile_flag(panel(spark, sf_dir).select("asset", "dn", "close"), "asset", "dn", "close", 0.8, 5, "above")
    return out.select("asset", F.col("dn").alias("day"), "above")


@query(f"""WITH {PANEL}, l AS (SELECT asset, dn, close >= 50 AS high FROM panel), n AS (SELECT *, high IS DISTINCT FROM lag(high) OVER w OR row_number() OVER w = 1 AS new FROM l WINDOW w AS (PARTITION BY asset ORDER BY dn))
SELECT asset, high, dn AS start, lead(dn) OVER (PARTITION BY asset ORDER BY dn) AS "end" FROM n WHERE new""")
def regime_windows(spark, sf_dir):
    p = panel(spark, sf_dir).select("asset", "dn", (F.col("close") >= 50).alias("high"))
    return windows.collapse_runs(p, "asset", "dn", "high")


FOLDS = [("train", 19723, 19733), ("dev", 19733, 19740), ("test", 19740, 19750)]


@query(f"""WITH {PANEL}, f(fold, s, e) AS (VALUES {", ".join(map(repr, FOLDS))}) SELECT asset, dn AS day, fold FROM panel LEFT JOIN f ON dn >= s AND dn < e""")
def fold_membership(spark, sf_dir):
    folds = spark.createDataFrame(FOLDS, "fold string, s int, e int")
    out = joins.interval_join(panel(spark, sf_dir).select("asset", "dn"), folds, "dn", "s", "e", ["fold"])
    return out.select("asset", F.col("dn").alias("day"), "fold")


@query(f"""WITH {PANEL}, f(fold, s, e) AS (VALUES {", ".join(map(repr, FOLDS))}) SELECT asset, dn AS day, array_to_string(list_sort(coalesce(list(fold) FILTER (fold IS NOT NULL), [])), ',') AS reasons FROM panel LEFT JOIN f ON dn < e AND dn + 5 >= s GROUP BY 1, 2""")
def overlap_reasons(spark, sf_dir):
    folds = spark.createDataFrame(FOLDS, "fold string, s int, e int")
    rows = panel(spark, sf_dir).select("asset", "dn", (F.col("dn") + 5).alias("label_end"))
    out = joins.overlap_reasons(rows, folds, "dn", "label_end", "s", "e", "fold")
    return out.select("asset", F.col("dn").alias("day"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {PANEL}, f(fold, s, e) AS (VALUES {", ".join(map(repr, FOLDS))}) SELECT asset, dn AS day, fold FROM panel JOIN f ON dn >= s AND dn < e WHERE dn + 2 + 1 < e""")
def purge_and_embargo(spark, sf_dir):
    """Fold rows whose two-day label, plus a day of embargo, ends inside the fold."""
    folds = spark.createDataFrame(FOLDS, "fold string, s int, e int")
    out = joins.interval_join(panel(spark, sf_dir).select("asset", "dn"), folds.withColumn("fold_end", F.col("e")), "dn", "s", "e", ["fold", "fold_end"])
    return out.filter(F.col("dn") + 3 < F.col("fold_end")).select("asset", F.col("dn").alias("day"), "fold")


@query(f"""WITH {PANEL}, r AS (SELECT asset, dn, CASE WHEN lead(dn) OVER ({W}) - dn = 1 AND close > 0 THEN lead(close) OVER ({W}) / close - 1 END AS fwd, fund IS NOT NULL AS hit FROM panel), g AS (
  SELECT dn, count(fwd) FILTER (hit) AS n1, count(fwd) FILTER (NOT hit) AS n0, avg(fwd) FILTER (hit) AS m1, avg(fwd) FILTER (NOT hit) AS m0, var_samp(fwd) FILTER (hit) AS v1, var_samp(fwd) FILTER (NOT hit) AS v0 FROM r GROUP BY dn)
SELECT dn AS day, n1, n0, round(m1 - m0, 6) AS diff, round(CASE WHEN n1 >= 2 AND n0 >= 2 AND sqrt(v1 / n1 + v0 / n0) > 0 THEN (m1 - m0) / sqrt(v1 / n1 + v0 / n0) END, 6) AS t,
  round(CASE WHEN n1 >= 2 AND n0 >= 2 AND sqrt(v1 / n1 + v0 / n0) > 0 THEN pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) END, 4) AS df FROM g""")
def welch_by_day(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("fwd", windows.relative(windows.contiguous_lead("asset", "day", "close", 1), F.col("close"))).withColumn("hit", F.col("fund").isNotNull())
    out = stats.welch(p, ["dn"], "hit", "fwd").select(F.col("dn").alias("day"), "n1", "n0", "diff", "t", F.round("df", 4).alias("df"))
    return rounded(out)


@query(f"""WITH {PANEL}, b AS (SELECT * FROM panel WHERE fund IS NOT NULL), r AS (SELECT dn, rank() OVER (PARTITION BY dn ORDER BY close) - 1 + (count(*) OVER (PARTITION BY dn, close) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY dn ORDER BY fund) - 1 + (count(*) OVER (PARTITION BY dn, fund) - 1) / 2.0::DOUBLE AS ry FROM b),
c AS (SELECT dn, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS rho FROM r GROUP BY dn)
SELECT dn AS day, n, round(rho, 6) AS rho, round(CASE WHEN abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END, 6) AS t FROM c""")
def spearman_by_day(spark, sf_dir):
    return rounded(stats.spearman(panel(spark, sf_dir), ["dn"], "close", "fund").withColumnRenamed("dn", "day"))


@query(f"""WITH {PANEL}, m AS (SELECT asset, close - 50 AS v FROM panel), t AS (SELECT asset, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_samp(v) > 0 THEN avg(v) / (stddev_samp(v) / sqrt(count(*))) END AS t FROM m GROUP BY asset)
SELECT asset, n, round(t, 6) AS t, round(sqrt(n) * 0 + t / sqrt(n) * sqrt(365), 6) AS sharpe FROM t""")
def t_and_sharpe(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("v", F.col("close") - 50)
    return rounded(p.groupBy("asset").agg(F.count("*").alias("n"), stats.t_stat("v").alias("t"), stats.sharpe("v").alias("sharpe")))


@query(f"""WITH {PANEL}, l AS (SELECT asset, fund, lag(fund) OVER ({W}) AS before FROM panel WHERE fund IS NOT NULL) SELECT asset, count(*) AS n, round(CASE WHEN count(before) > 2 THEN corr(fund, before) END, 6) AS rho FROM l GROUP BY asset""")
def autocorrelation(spark, sf_dir):
    p = panel(spark, sf_dir).filter("fund is not null").withColumn("before", F.lag("fund").over(Window.partitionBy("asset").orderBy("day")))
    return rounded(p.groupBy("asset").agg(F.count("*").alias("n"), F.when(F.count("before") > 2, F.corr("fund", "before")).alias("rho")))


@query(f"""WITH {PANEL}, b AS (SELECT asset, count(*) AS n, count(fund) AS k FROM panel GROUP BY asset)
SELECT asset, round((k / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS low,
round((k / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM b""")
def wilson_intervals(spark, sf_dir):
    g = panel(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.count("fund").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(g.select("asset", low.alias("low"), high.alias("high")))


@query(f"""WITH {PANEL}, b AS (SELECT asset, count(*) AS n, count(*) FILTER (close > 50) AS k FROM panel GROUP BY asset)
SELECT asset, n, k, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(k, n + 1) t(i)), 6) AS p FROM b""")
def sign_tests(spark, sf_dir):
    g = panel(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.count_if(F.col("close") > 50).alias("k"))
    return rounded(g.withColumn("p", stats.sign_test_p(F.col("k"), F.col("n"))))


@query(f"""WITH {PANEL}, b AS (SELECT asset, exp(-abs(avg(close) - 50)) AS p FROM panel GROUP BY asset), k AS (SELECT *, row_number() OVER (ORDER BY p, asset) AS r, count(*) OVER () AS m FROM b)
SELECT asset, r AS rank, round(0.05::DOUBLE * r / m, 6) AS threshold, p <= 0.05::DOUBLE * r / m AS passes FROM k""")
def fdr_table(spark, sf_dir):
    mean = stats.ordered_sum("close", "dn") / F.count("close")  # assets tie, so the last bit decides a rank
    g = panel(spark, sf_dir).groupBy("asset").agg(F.exp(-F.abs(mean - 50)).alias("p")).withColumn("family", F.lit(1))
    return rounded(stats.benjamini_hochberg(g, ["family"], "p", "asset", untested=True).select("asset", "rank", "threshold", "passes"))


@query(f"""WITH {PANEL} SELECT asset, dn AS day FROM (SELECT asset, dn, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY dn) - 1 AS i FROM panel) WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda k: CAST(round_even(k * (n - 1) / 4.0::DOUBLE, 0) AS INT)), i)""")
def evenly_spaced_sample(spark, sf_dir):
    return books.evenly_spaced(panel(spark, sf_dir).select("asset", "dn"), ["asset"], "dn", 5).withColumnRenamed("dn", "day")


@query(f"""WITH {PANEL}, f AS (SELECT *, dense_rank() OVER (ORDER BY dn) - 1 AS i FROM panel), s AS (SELECT asset, dn, row_number() OVER (PARTITION BY asset ORDER BY dn) AS k, count(*) OVER (PARTITION BY asset) AS n FROM f WHERE i % 4 = 0) SELECT asset, dn AS day, CASE WHEN k > floor(n * (1 - 0.25::DOUBLE)) THEN 'eval' ELSE 'train' END AS split FROM s""")
def stride_and_tail_split(spark, sf_dir):
    """Every fourth of the distinct days, found first and broadcast, then the last quarter of each asset's rows."""
    p = panel(spark, sf_dir).select("asset", "dn")
    days = p.select("dn").distinct().withColumn("i", F.row_number().over(Window.orderBy("dn")) - 1).filter("i % 4 = 0").select("dn")
    return books.temporal_tail(p.join(F.broadcast(days), "dn", "leftsemi"), ["asset"], "dn", 0.25).withColumnRenamed("dn", "day")


@query(f"""WITH RECURSIVE {PANEL}, p AS (SELECT asset, dn FROM panel), r(asset, dn) AS (SELECT asset, min(dn) FROM p GROUP BY asset UNION ALL SELECT asset, dn FROM (SELECT r.asset, min(p.dn) AS dn FROM r JOIN p ON p.asset = r.asset AND p.dn >= r.dn + 4 GROUP BY r.asset, r.dn))
SELECT asset, CAST(dn AS BIGINT) AS day FROM r""")
def greedy_spacing(spark, sf_dir):
    return corpus.spaced(panel(spark, sf_dir), ["asset"], "dn", 4).withColumnRenamed("dn", "day")


@query(f"""WITH {PANEL}, d AS (SELECT asset, dn, list_sort(list(qv) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS h FROM panel) SELECT asset, dn AS day, round(list_aggregate(h, 'median'), 6) AS median, list_aggregate(h, 'median') >= 100 AS liquid FROM d WHERE len(h) = 5""")
def liquidity_screen(spark, sf_dir):
    """Five days are needed, not five amounts: days without one count as days, and five such days have no median."""
    days = F.count(F.lit(1)).over(Window.partitionBy("asset").orderBy("day").rowsBetween(-4, 0))
    out = panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), days.alias("days"), windows.trailing_median("asset", "day", "qv", 5, 1, inclusive=True).alias("median"))
    return rounded(out.filter("days = 5").drop("days").withColumn("liquid", F.col("median") >= 100))


@query(f"""WITH {PANEL}, q AS (SELECT asset, dn, close, fund IS NOT NULL AS on_ FROM panel) SELECT year(DATE '1970-01-01' + CAST(dn AS INT)) AS year, round(avg(close) FILTER (on_), 6) AS "on", round(avg(close) FILTER (NOT on_), 6) AS off, count(*) AS n, avg(close) FILTER (on_) > avg(close) FILTER (NOT on_) AS positive FROM q GROUP BY 1""")
def year_sign_table(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("flag", F.col("fund").isNotNull())
    return rounded(books.year_signs(p, "day", "flag", "close"))


@query(f"""WITH {PANEL}, g AS (SELECT asset, dn, fund > 50 AS a, CASE WHEN fund IS NOT NULL THEN close > 50 END AS b, close > 20 AS c FROM panel) SELECT asset, dn AS day, CASE WHEN a IS NULL OR c IS NULL THEN NULL ELSE a AND c END AS both, CASE WHEN a IS NULL OR c IS NULL THEN NULL ELSE c AND NOT a END AS without FROM g""")
def three_valued_gates(spark, sf_dir):
    p = panel(spark, sf_dir)
    a, c = F.col("fund") > 50, F.col("close") > 20
    return p.select("asset", F.col("dn").alias("day"), books.both_known(a, c, a & c).alias("both"), books.both_known(a, c, c & ~a).alias("without"))


@query(f"""WITH {PANEL}, f AS (SELECT dn, ln(close) AS y, ln(qv) AS x1, CAST(n AS DOUBLE) AS x2 FROM panel WHERE close > 0 AND qv > 0)
SELECT dn AS day, count(*) AS n, round(sum(x1), 4) AS sx1, round(sum(x1 * x2), 4) AS sx12, round(sum(x1 * y), 4) AS sx1y, round(sum(y * y), 4) AS syy FROM f GROUP BY dn""")
def ridge_grams_by_day(spark, sf_dir):
    """The normal equations of a daily walk-forward ridge, one aggregate for all days."""
    p = panel(spark, sf_dir).filter("close > 0 and qv > 0").withColumns({"x1": F.ln("qv"), "x2": F.col("n").cast("double"), "y": F.ln("close")})
    g = stats.ridge_grams(p, ["dn"], ["x1", "x2"], "y")
    return g.select(F.col("dn").alias("day"), F.col("g_0_0").cast("long").alias("n"), *[F.round(a, 4).alias(b) for a, b in (("g_0_1", "sx1"), ("g_1_2", "sx12"), ("g_1_3", "sx1y"), ("g_3_3", "syy"))])
