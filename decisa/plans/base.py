"""What the queries share: a registry, table readers and the derived panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisa.functions.stats import ordered_sum

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the DuckDB SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, for results that are compared as values."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def day_number(day):
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, day, dn (day number), close (the day's last value), qv, n, fund (its last purchase value, may be null).

    qv is added up in the order of the events, as the SQL does on one thread: days are compared by it, and equal amounts
    must not differ in the last bit. An asset's events of a day meet in one row where qv is used."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    at, buys = F.struct("ts", "event_id"), F.col("event_type") == "purchase"
    return (
        e.groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("day"))
        .agg(F.max_by("value", at).alias("close"), ordered_sum("value", "ts", "event_id").alias("qv"), F.count("*").alias("n"), F.max_by(F.when(buys, F.col("value")), F.when(buys, at)).alias("fund"))
        .withColumn("dn", day_number(F.col("day")))
    )


PANEL = """panel AS (
  SELECT user_id AS asset, CAST(ts AS DATE) AS day, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS dn, last(value ORDER BY ts, event_id) AS close,
    sum(value) AS qv, count(*) AS n, last(value ORDER BY ts, event_id) FILTER (WHERE event_type = 'purchase') AS fund
  FROM events GROUP BY 1, 2, 3
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a probability of each class that a hash of the id gives: id, y, p, probs, label, grp, split, conf, correct."""
    unit = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") / float(16**8)
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), "toxic")
    p = F.lit(0.15) + F.lit(0.5) * F.col("u") + F.lit(0.3) * F.col("y")
    rows = rows.withColumn("u", unit).withColumn("p", p)
    rows = rows.withColumns({"label": F.col("y").cast("string"), "probs": F.create_map(F.lit("1"), F.col("p"), F.lit("0"), 1 - F.col("p"))})
    return rows.withColumns({"grp": F.col("id") % 7, "split": F.when(F.col("id") % 3 == 0, "eval").otherwise("fit"), "conf": F.greatest(F.col("p"), 1 - F.col("p")), "correct": (F.col("p") >= 0.5) == (F.col("y") == 1)})


SCORED = """u AS (
  SELECT doc_id AS id, quality AS y, toxic, CAST(('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM labels
), scored AS (
  SELECT *, 0.15::DOUBLE + 0.5::DOUBLE * u + 0.3::DOUBLE * y AS p, id % 7 AS grp, CASE WHEN id % 3 = 0 THEN 'eval' ELSE 'fit' END AS split,
    greatest(0.15::DOUBLE + 0.5::DOUBLE * u + 0.3::DOUBLE * y, 1 - (0.15::DOUBLE + 0.5::DOUBLE * u + 0.3::DOUBLE * y)) AS conf,
    (0.15::DOUBLE + 0.5::DOUBLE * u + 0.3::DOUBLE * y >= 0.5) = (y = 1) AS correct
  FROM u
)"""
