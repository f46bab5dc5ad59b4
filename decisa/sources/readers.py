"""Sources: strict JSON lines, contract CSV, zipped CSV members, tolerant logs, request segments."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decisa.functions.jsons import parse


#: File names up to this number are broadcast.
BROADCAST_FILES = 100_000


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line with a declared schema; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_json(column):
    """Why a text is not strict JSON: null when it is; `empty` for blank and null texts, else `not JSON`: broken syntax,
    repeated keys, NaN and infinities, and more behind the value. Column expressions, by way of VARIANT."""
    blank = F.coalesce(F.length(F.trim(column)), F.lit(0)) == 0
    return F.when(blank, "empty").when(parse(column).isNull(), "not JSON")


def read_strict_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(value, fault) of every line that isn't blank."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select("value", strict_json(F.col("value")).alias("fault"))


def read_splits(spark: SparkSession, folder: str, splits: list[str], schema: StructType | str, group: str) -> DataFrame:
    """`{split}.jsonl` files with a split column; an id or a group in two splits is an error."""
    out = None
    for name in splits:
        part = read_jsonl(spark, f"{folder}/{name}.jsonl", schema).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    for key in ("id", group):
        crossed = out.groupBy(key).agg(F.countDistinct("split").alias("n")).filter(f"n > 1 and `{key}` is not null")
        if not crossed.isEmpty():
            raise ValueError(f"a value of {key} is in two splits")
    return out


def read_contract_csv(spark: SparkSession, path: str, header: list[str], schema: StructType | str) -> DataFrame:
    """CSV files whose header line starts with the contract; files with another header are left out whole, malformed
    rows are dropped."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.filter("at = 0").groupBy(F.col("file_path").alias("file")).agg(F.min_by("value", "n").alias("head"))  # ids of a file's block are in its order
    good = first.filter(F.ltrim("head", F.lit("\ufeff")).startswith(",".join(header))).select("file")
    rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", True).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
    return rows.join(F.broadcast(good) if good.count() <= BROADCAST_FILES else good, "file", "leftsemi").drop("file")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, obs_ns, value) of metrics files: the first column is a UTC stamp in text, the second the symbol, the
    fourth the value. Headers and lines with fewer fields, another stamp or no number are skipped."""
    parts = F.split(F.col("value"), ",")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 4)
    stamp = F.try_to_timestamp(F.get("p", 0), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = lines.select(F.get("p", 1).alias("symbol"), (F.unix_micros(stamp) * 1000).alias("obs_ns"), F.expr("try_cast(get(p, 3) as double)").alias("value"))
    return rows.filter("obs_ns is not null and value is not null")


def read_settled(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, calc_time, interval_hours, rate) of settlement files: calc_time in ms, hours, rate, symbol. Headers and
    lines that aren't of this form are skipped; rows come in no order, sort them by (symbol, calc_time)."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("p")).filter(F.size("p") >= 4)
    rows = lines.select(F.get("p", 3).alias("symbol"), F.expr("try_cast(get(p, 0) as bigint)").alias("calc_time"), F.expr("try_cast(get(p, 1) as int)").alias("interval_hours"), F.expr("try_cast(get(p, 2) as double)").alias("rate"))
    return rows.filter("calc_time is not null and rate is not null")


KLINE = "file string, symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long"


def read_zipped_bars(spark: SparkSession, path: str) -> DataFrame:
    """The first member of every zip: bars by open_time; of a bar in several files the last file's counts. Headers and
    short lines are skipped. A file's symbol is its name up to the first dash."""
    schema = pa.schema([("file", pa.string()), ("symbol", pa.string()), *[(c, pa.int64() if c.endswith("time") else pa.float64()) for c in ("open_time", "open", "high", "low", "close", "volume", "close_time")]])

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, symbol = [], file.rsplit("/", 1)[-1].split("-", 1)[0]
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for line in z.read(z.namelist()[0]).decode().splitlines():
                        parts = line.split(",")
                        if len(parts) >= 7 and parts[0].isdigit():
                            rows.append((file, symbol, int(parts[0]), *map(float, parts[1:6]), int(parts[6])))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, KLINE)
    w = Window.partitionBy("symbol", "open_time").orderBy(F.desc("file"))
    return got.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, counts of good and malformed lines): a bad line is counted, never fatal."""
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(parsed.alias("r"))
    good = rows.filter("r._corrupt is null").select("r.*").drop("_corrupt")
    return good, rows.groupBy(F.col("r._corrupt").isNotNull().alias("malformed")).agg(F.count("*").alias("n"))


MESSAGES = "messages array<struct<role: string, content: string>>"


def request_segments(df: DataFrame, key: str, body: str, most_bytes: int = 128_000, most: int = 128) -> DataFrame:
    """(key, pos, pointer, role, value, reason): a request body's messages as segments, or one row with why it is
    passed by (too_large, not_json, no_messages, too_many)."""
    r = df.select(key, F.col(body).alias("_b"), F.from_json(body, MESSAGES).alias("_r"))
    n = F.coalesce(F.size("_r.messages"), F.lit(0))
    reason = F.when(F.octet_length("_b") > most_bytes, "too_large").when(F.col("_r").isNull(), "not_json").when(n <= 0, "no_messages").when(n > most, "too_many")
    r = r.withColumn("reason", reason)
    return r.select(key, "reason", F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("_r.messages"))).alias("pos", "_m")).select(
        key, "pos", F.when(F.col("pos").isNotNull(), F.concat(F.lit("/messages/"), F.col("pos"), F.lit("/content"))).alias("pointer"), F.col("_m.role").alias("role"), F.col("_m.content").alias("value"), "reason",
    )


def date_spine(spark: SparkSession, start: str, end: str, step: str = "1 month") -> DataFrame:
    """(day): the first days of an archive's periods from start to end."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step})")).alias("day"))


# How a label may be spelt.
TRUE_WORDS = ("yes", "y", "d", "drop", "true", "1", "irrelevant")
FALSE_WORDS = ("no", "n", "k", "keep", "false", "0", "relevant")
UNCERTAIN_WORDS = ("uncertain", "u", "unsure", "?", "skip")


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, label, note, fault) of label files whose columns are found by what their names begin with: record_id,
    label, and note or evidence, in any case and order, spaces around them aside.

    label: true, false or uncertain, of any of their spellings. A row without an id is left out; of several rows of one id
    that have a label the last one counts, files in order of their names. fault: empty, or unrecognized; then the label is
    null. A file without the first two columns is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    plain = {c: c.strip().lower().removeprefix("\ufeff") for c in rows.columns}
    found = lambda *starts: next((F.col(f"`{c}`") for c, name in plain.items() if name.startswith(starts)), None)
    record, label, note = found("record_id"), found("label"), found("note", "evidence")
    if record is None or label is None:
        raise ValueError(f"{path} needs the columns record_id and label, not {rows.columns}")
    trimmed = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select(trimmed(record).alias("record_id"), F.lower(trimmed(label)).alias("word"), trimmed(note if note is not None else F.lit("")).alias("note"), order.alias("o")).filter("record_id <> ''")
    last = rows.groupBy("record_id").agg(F.max_by(F.struct("word", "note"), F.struct((F.col("word") != "").alias("said"), "o")).alias("r")).select("record_id", "r.*")
    known = F.when(F.col("word").isin(*TRUE_WORDS), "true").when(F.col("word").isin(*FALSE_WORDS), "false").when(F.col("word").isin(*UNCERTAIN_WORDS), "uncertain")
    fault = F.when(F.col("word") == "", "empty").when(known.isNull(), "unrecognized")
    return last.select("record_id", known.alias("label"), F.nullif("note", F.lit("")).alias("note"), fault.alias("fault"))
