"""The daily book as a stream: a date is decided once all assets have passed it, and never again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisa.operators.panel import daily_ledger
from decisa.session import materialize
from decisa.sources.sinks import append_unseen

LEDGER = "day int, event string, changed long, cost_bps double, gross_bps double, net_bps double, booked_bps double"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def decide_closed(batch: DataFrame, batch_id: int, path: str, edge: int, least: int, cost_bps: float, grace: int | None = None) -> None:
    """Take in one micro-batch of (asset, day, close) and decide the dates that it closes.

    Below path: rows (one an asset and date), ledger (daily_ledger()'s rows of decided dates), late (rows that came for a
    decided date, which no longer count), log (the batches done). A date is closed when each known asset has a later
    one, or the newest date is more than `grace` after it. A batch that is in the log adds nothing; one that failed on
    the way can run again, as every part is appended by key and the log last. Work follows the rows from the last decided
    date on, and a row an asset."""
    spark = batch.sparkSession
    kind = batch.schema["asset"].dataType.simpleString()  # kept as it is: equal closes are ranked by asset, numbers as numbers
    if not _read(spark, f"{path}/log", "batch long").filter(F.col("batch") == batch_id).isEmpty():
        return
    rows = materialize(batch.select("asset", F.col("day").cast("int").alias("day"), F.col("close").cast("double").alias("close")).dropna(subset=["asset", "day"]), "day-batch")
    ledger = _read(spark, f"{path}/ledger", LEDGER)
    last = ledger.agg(F.max("day").alias("day"), F.max_by("booked_bps", "day").alias("booked")).first()
    decided = F.lit(last["day"]).cast("int")
    fresh = F.coalesce(F.col("day") > decided, F.lit(True))
    append_unseen(rows.filter(~fresh).withColumn("batch", F.lit(batch_id).cast("long")), f"{path}/late", ["asset", "day", "batch"])
    append_unseen(rows.filter(fresh), f"{path}/rows", ["asset", "day"])
    known = _read(spark, f"{path}/rows", f"asset {kind}, day int, close double")
    newest = known.groupBy("asset").agg(F.max("day").alias("day")).agg(F.min("day").alias("all"), F.max("day").alias("any")).first()
    if newest["all"] is not None:
        until = newest["all"] if grace is None else max(newest["all"], newest["any"] - grace)
        # the last decided date is read again for its book, against which the next one changes
        part = known.filter(F.col("day") < until).filter(F.coalesce(F.col("day") >= decided, F.lit(True)))
        found = materialize(daily_ledger(part, "day", "asset", "close", "close", edge, least, cost_bps), "day-ledger")
        if last["day"] is not None:
            base = found.filter(F.col("day") == decided).agg(F.max("booked_bps").alias("base")).first()["base"] or 0.0
            found = found.filter(F.col("day") > decided).withColumn("booked_bps", F.col("booked_bps") - F.lit(base) + F.lit(last["booked"]))
        typed = [F.col(c.split()[0]).cast(c.split()[1]) for c in LEDGER.split(", ")]
        append_unseen(found.select(*typed), f"{path}/ledger", ["day"])
    append_unseen(spark.createDataFrame([(batch_id,)], "batch long"), f"{path}/log", ["batch"])


def stream_daily_book(closes: DataFrame, path: str, checkpoint: str, edge: int, least: int, cost_bps: float, grace: int | None = None):
    """A writer that decides closed dates of a stream of (asset, day, close); see decide_closed()."""
    decide = lambda batch, id_: decide_closed(batch, id_, path, edge, least, cost_bps, grace)
    return closes.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)


STATE = "version long, day int, rows long, digest string"


def probe(ledger: DataFrame, path: str, gross: str = "gross_bps", cost: str = "cost_bps", booked: str = "booked_bps", tolerance: float = 0.05) -> DataFrame:
    """(day, issue, before, now): what is wrong with a ledger of days against the state that the last probe saved.

    lost_date: a saved date is gone; shrunk: it has fewer rows; rewritten: it has other values; new_in_past: a date before
    the newest saved one that wasn't there; not_resummed: booked isn't the running sum of gross less cost, within the
    tolerance; not_finite: it is no number. The state, a row a date, is then saved as the next version, so a second probe
    of the same ledger finds only what doesn't depend on the state. Versions are never changed."""
    from pyspark.sql import Window

    spark = ledger.sparkSession
    cols = sorted(c for c in ledger.columns if c != "day")
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    now = ledger.groupBy(F.col("day").cast("int").alias("day")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(text)), "\n"), 256).alias("digest"))
    now = materialize(now, "probe")
    saved = _read(spark, path, STATE)
    version = saved.agg(F.max("version").alias("v")).first()["v"]
    before = materialize(saved.filter(F.col("version") == F.lit(version)).select("day", F.col("rows").alias("was"), F.col("digest").alias("had")), "probe")
    newest = F.lit(before.agg(F.max("day").alias("d")).first()["d"]).cast("int")
    both = before.join(now, "day", "full_outer")
    issue = (
        F.when(F.col("rows").isNull(), "lost_date").when(F.col("was").isNull(), F.when(F.col("day") < newest, "new_in_past"))
        .when(F.col("rows") < F.col("was"), "shrunk").when(F.col("digest") != F.col("had"), "rewritten")
    )
    as_text = lambda c: F.col(c).cast("string")
    changed = both.withColumn("issue", issue).filter("issue is not null").select("day", "issue", as_text("was").alias("before"), as_text("rows").alias("now"))
    order = Window.orderBy("day")  # a row a date
    days = ledger.select(F.col("day").cast("int").alias("day"), *[F.col(c).cast("double").alias(n) for c, n in ((gross, "g"), (cost, "c"), (booked, "b"))])
    sums = days.withColumn("s", F.coalesce(F.sum("g").over(order), F.lit(0.0)) - F.sum(F.coalesce("c", F.lit(0.0))).over(order))
    wrong = F.when(F.col("b").isNull() | F.isnan("b") | (F.abs("b") == float("inf")), "not_finite").when(F.abs(F.col("b") - F.col("s")) > tolerance, "not_resummed")
    resummed = sums.withColumn("issue", wrong).filter("issue is not null").select("day", "issue", F.round("b", 4).cast("string").alias("before"), F.round("s", 4).cast("string").alias("now"))
    out = materialize(changed.unionByName(resummed), "probe-issues")
    now.select(F.lit((version or 0) + 1).cast("long").alias("version"), "day", "rows", "digest").write.mode("append").parquet(path)
    return out
