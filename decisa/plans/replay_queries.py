"""Event-time queries: windows, counters, idempotent appends, receipts, request segments and strict JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisa.operators import resample
from decisa.plans.base import PANEL, panel, query, rounded, table
from decisa.sources import readers, sinks
from decisa.streaming import windows as event_time


@query("""SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf_dir):
    return rounded(event_time.windowed(table(spark, sf_dir, "events"), "6 hours"))


@query("""SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(3) r(k) GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    return rounded(event_time.windowed(table(spark, sf_dir, "events"), "3 hours", "1 hour"))


@query("""WITH g AS (SELECT *, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 43200000000, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(us) AS start, max(us) + 43200000000 AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return rounded(event_time.sessions(table(spark, sf_dir, "events"), "12 hours"))


@query("""SELECT event_id, count(*) OVER w AS orders, round(sum(abs(value)) OVER w, 6) AS turnover FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""")
def risk_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return rounded(event_time.rolling_counters(e, ["user_id"], "s", 86_400, "value").select("event_id", "orders", "turnover"))


@query(f"WITH {PANEL} SELECT asset, dn AS day, round(close, 6) AS close FROM panel")
def idempotent_ledger(spark, sf_dir):
    """Two appends of overlapping halves, then a repeat: each key is there once."""
    from decisa.session import fresh_path

    p, path = rounded(panel(spark, sf_dir).select("asset", F.col("dn").alias("day"), "close")), fresh_path(spark, "ledger")
    sinks.append_unseen(p.filter("day % 3 <> 0"), path, ["asset", "day"])
    sinks.append_unseen(p.filter("day % 2 = 0"), path, ["asset", "day"])
    sinks.append_unseen(p, path, ["asset", "day"])
    sinks.append_unseen(p, path, ["asset", "day"])
    return spark.read.parquet(path)


@query("SELECT count(*) AS rows, true AS same FROM orders")
def order_free_receipt(spark, sf_dir):
    """The identity of a table's content is the same for another order and partitioning of its rows."""
    o = table(spark, sf_dir, "orders")
    a, b = sinks.receipt(o), sinks.receipt(o.repartition(5, "o_custkey").sort("o_totalprice")).select(F.col("identity").alias("other"))
    return a.join(F.broadcast(b)).select("rows", (F.col("identity") == F.col("other")).alias("same"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id) AS b FROM conversations)
SELECT conv_id, CAST(pos AS INT) AS pos, '/messages/' || pos || '/content' AS pointer, role, md5(text) AS digest FROM m""")
def request_segments(spark, sf_dir):
    """Each conversation as a JSON request body, parsed back to segments."""
    t = table(spark, sf_dir, "conversations")
    body = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m")))).alias("m"))
    body = body.select("conv_id", F.to_json(F.struct(F.transform("m", lambda x: x["m"]).alias("messages"))).alias("body"))
    return readers.request_segments(body, "conv_id", "body").select("conv_id", "pos", "pointer", "role", F.md5("value").alias("digest"))


@query("SELECT event_id, event_type NOT IN ('error', 'click', 'signup') AS fine FROM events")
def strict_json_props(spark, sf_dir):
    """Every props text through the strict parser; those of errors repeat a key, those of clicks hold NaN, those of
    signups go on behind the value, which Spark's own reader lets pass."""
    bare = F.substring(F.col("props"), F.lit(2), F.length("props"))
    kind = F.col("event_type")
    props = F.when(kind == "error", F.concat(F.lit('{"k":1,'), bare)).when(kind == "click", F.concat(F.lit('{"n":NaN,'), bare)).when(kind == "signup", F.concat("props", F.lit(" 1"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", readers.strict_json(props).isNull().alias("fine"))


@query(f"""WITH {PANEL}, d AS (SELECT dn, asset, close, row_number() OVER (PARTITION BY dn ORDER BY asset) AS k, row_number() OVER (PARTITION BY dn ORDER BY sha256('p|' || dn || '|' || asset), asset) AS h FROM panel)
SELECT a.dn AS day, a.asset, round(b.close, 6) AS placebo FROM d a JOIN d b ON a.dn = b.dn AND a.k = b.h""")
def placebo_shuffle(spark, sf_dir):
    p = panel(spark, sf_dir).select("dn", "asset", "close")
    return rounded(resample.placebo(p, ["dn"], "asset", "close", "p", "placebo").select(F.col("dn").alias("day"), "asset", "placebo"))
