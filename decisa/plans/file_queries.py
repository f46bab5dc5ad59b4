"""Queries on files that are written from the tables and read back, and on row contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisa.functions import probs, text
from decisa.operators import joins, validate
from decisa.plans.base import SCORED, query, scored, table
from decisa.plans.record_queries import TURNS, _turns
from decisa.session import fresh_path
from decisa.sources import readers, sinks

SPLIT = "CASE WHEN CAST('0x' || substring(sha256('s:' || coalesce(source, '')), 1, 8) AS BIGINT) % 5 = 0 THEN 'test' WHEN CAST('0x' || substring(sha256('s:' || coalesce(source, '')), 1, 8) AS BIGINT) % 5 = 1 THEN 'dev' ELSE 'train' END"


def _split(d):
    bucket = text.hash_bucket(F.coalesce("source", F.lit("")), "s", 5)
    return d.withColumn("split", F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train"))


@query(f"SELECT doc_id AS id, {SPLIT} AS split, md5(text) AS digest FROM documents")
def split_scan(spark, sf_dir):
    """Documents written as JSON lines of three splits, no source in two of them, and read back with their split."""
    d, folder = _split(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")), fresh_path(spark, "splits")
    for name in ("train", "dev", "test"):
        sinks.write_jsonl(d.filter(F.col("split") == name).drop("split"), f"{folder}/{name}.jsonl")
    return readers.read_splits(spark, folder, ["train", "dev", "test"], "id long, source string, text string", "source").select("id", "split", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type IN ('view', 'purchase')")
def contract_csv(spark, sf_dir):
    """Event files a type each, of which only those with the contract's header are read."""
    e, folder = table(spark, sf_dir, "events"), fresh_path(spark, "contract")
    fits = F.col("event_type").isin("view", "purchase")
    e.filter(fits).select("event_id", "user_id", "value").write.option("header", True).csv(f"{folder}/a")
    e.filter(~fits).select("user_id", "event_id", "value").write.option("header", True).csv(f"{folder}/b")
    rows = readers.read_contract_csv(spark, f"{folder}/*", ["event_id", "user_id", "value"], "event_id long, user_id long, value double")
    return rows.select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""SELECT event_type, count(*) AS lines, count(*) FILTER (value >= 20) AS good, round(coalesce(sum(value) FILTER (value >= 20), 0), 4) AS total FROM events GROUP BY 1""")
def usage_log(spark, sf_dir):
    """A log of JSON lines in which those of small values are cut short: bad lines are counted, the others are read."""
    e, path = table(spark, sf_dir, "events"), fresh_path(spark, "log")
    line = F.to_json(F.struct("event_type", "event_id", "value"))
    e.select(F.when(F.col("value") >= 20, line).otherwise(F.substring(line, F.lit(1), F.length(line) - 3)).alias("line")).write.text(path)
    good, counts = readers.read_log(spark, path, "event_type string, event_id long, value double")
    lines = e.groupBy("event_type").agg(F.count("*").alias("lines"))
    told = counts.agg(F.sum("n").alias("told"))
    g = good.groupBy("event_type").agg(F.count("*").alias("good"), F.sum("value").alias("total"))
    out = lines.join(g, "event_type", "left").join(F.broadcast(told)).filter("told > 0")
    return out.select("event_type", "lines", F.coalesce("good", F.lit(0)).alias("good"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@query(f"""WITH {SCORED}, t AS (SELECT id, round(p * 2) / 2 AS a, round(u * 2) / 2 AS b FROM scored)
SELECT id, CASE WHEN a >= b AND a >= 0.5 THEN 'a' WHEN b >= 0.5 THEN 'b' ELSE 'c' END AS first, CASE WHEN 0.5 >= greatest(a, b) THEN 'c' WHEN b >= a THEN 'b' ELSE 'a' END AS largest FROM t""")
def argmax_ties(spark, sf_dir):
    """The largest of three coarse probabilities, ties to the first label or to the largest one."""
    t = scored(spark, sf_dir).select("id", (F.round(F.col("p") * 2) / 2).alias("a"), (F.round(F.col("u") * 2) / 2).alias("b"))
    labels, p = F.array(*map(F.lit, "abc")), F.array("a", "b", F.lit(0.5))
    return t.select("id", probs.argmax_first(labels, p).alias("first"), probs.argmax_largest_key(F.map_from_arrays(labels, p)).alias("largest"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents""")
def whitespace_squash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squash(F.col("text")).cast("binary")).alias("digest"))


@query(f"""WITH {TURNS}, q AS (SELECT conv_id, i, CASE role WHEN 'user' THEN 'choice' WHEN 'assistant' THEN 'score' ELSE 'boolean' END AS kind, string_split(text, '.') AS c FROM turns)
SELECT conv_id, i, CASE WHEN NOT CASE kind WHEN 'choice' THEN len(c) BETWEEN 2 AND 255 WHEN 'score' THEN len(c) BETWEEN 2 AND 10 ELSE len(c) IN (0, 2) END THEN 'criteria_count' WHEN len(list_filter(c, lambda x: trim(x) = '')) > 0 THEN 'blank_criterion' END AS reason FROM q""")
def question_contract(spark, sf_dir):
    """Questions whose criteria are a turn's sentences against the contract of their kind."""
    t = _turns(spark, sf_dir)
    kind = F.when(F.col("role") == "user", "choice").when(F.col("role") == "assistant", "score").otherwise("boolean")
    q = t.select("conv_id", F.col("i").cast("long").alias("i"), kind.alias("kind"), F.split("text", r"\.", -1).alias("c"))
    return q.select("conv_id", "i", validate.question_reason("kind", "c").alias("reason"))


@query(f"""WITH {SCORED}, t AS (SELECT id, CASE WHEN u < 0.1 THEN NULL WHEN u < 0.2 THEN p + 1 ELSE p END AS a, CASE WHEN u > 0.9 THEN 0.25 ELSE 1 - p END AS b, CASE WHEN toxic = 1 THEN 'c' ELSE 'a' END AS gold FROM scored)
SELECT id, CASE WHEN a IS NULL OR a > 1 THEN 'out_of_range' WHEN abs(a + b - 1) > 1e-8 THEN 'sum' WHEN gold = 'c' THEN 'unknown_gold' END AS reason FROM t""")
def target_distributions(spark, sf_dir):
    """Training targets with nulls, values above 1, wrong sums and unknown labels, and why each is refused."""
    u, p = F.col("u"), F.col("p")
    a = F.when(u < 0.1, F.lit(None).cast("double")).when(u < 0.2, p + 1).otherwise(p)
    m = F.create_map(F.lit("a"), a, F.lit("b"), F.when(u > 0.9, 0.25).otherwise(1 - p))
    t = scored(spark, sf_dir).select("id", m.alias("m"), F.when(F.col("toxic") == 1, "c").otherwise("a").alias("gold"))
    return t.select("id", validate.distribution_reason("m", "gold").alias("reason"))


@query(f"SELECT {SPLIT} = 'test' AS test, count(*) AS n, count(DISTINCT source) AS sources FROM documents WHERE source IS NOT NULL GROUP BY 1")
def isolated_sides(spark, sf_dir):
    """Fit and test sides that are proven to share no source before they are counted."""
    d = _split(table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", "source"))
    d = d.withColumn("test", F.col("split") == "test")
    joins.assert_isolated(d.filter("not test"), d.filter("test"), ["source", "doc_id"])
    return d.groupBy("test").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("""WITH m AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS d)
SELECT datediff('day', DATE '1970-01-01', d) AS day, count(o_orderkey) AS orders FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate) = d GROUP BY 1""")
def monthly_spine(spark, sf_dir):
    """Orders of each month of the table's range, months without one too."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    ends = o.agg(F.date_format(F.trunc(F.min("d"), "month"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("z")).first()
    months = readers.date_spine(spark, ends["a"], ends["z"])
    o = o.groupBy(F.trunc("d", "month").alias("day")).agg(F.count("*").alias("n"))
    return months.join(o, "day", "left").select(F.datediff("day", F.lit("1970-01-01").cast("date")).alias("day"), F.coalesce("n", F.lit(0)).alias("orders"))
