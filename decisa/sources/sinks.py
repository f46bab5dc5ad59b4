"""Sinks: JSON lines, idempotent keyed appends, manifests, receipts, exclusive and resumable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisa.functions.jsons import canonical


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object a row; refuses to overwrite."""
    df.write.mode("errorifexists").json(path)


def _unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key isn't in seen; null keys are equal to each other."""
    known = seen.select(*[F.col(k).alias(f"_seen_{i}") for i, k in enumerate(keys)])
    same = [df[k].eqNullSafe(known[f"_seen_{i}"]) for i, k in enumerate(keys)]
    return df.join(known, same, "leftanti")


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """What a path holds; None before the first write."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def append_unseen(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose key the ledger doesn't have yet; a repeated run appends nothing. Returns the rows appended.

    Null keys are keys like others. Of several new rows of one key, that with the smallest JSON text is taken, so a rerun
    takes the same one."""
    spark = df.sparkSession
    row = F.struct(*df.columns)
    fresh = df.groupBy(*keys).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("_row")).select("_row.*")
    ledger = _written(spark, path)
    if ledger is not None:
        fresh = _unseen(fresh, ledger, keys)
    from decisa.session import materialize

    fresh = materialize(fresh, "unseen")  # the ledger is read to the end before it grows
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def stream_append_unseen(df: DataFrame, path: str, keys: list[str], checkpoint: str):
    """The same for a stream: each micro-batch is appended by key, so a replayed batch adds nothing."""
    return df.writeStream.foreachBatch(lambda batch, _: append_unseen(batch, path, keys) and None).option("checkpointLocation", checkpoint)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a manifest."""
    now, was = manifest(spark, path), expected.select("file", F.col("bytes").alias("was_bytes"), F.col("sha256").alias("was"))
    both = now.join(was, "file", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("sha256") != F.col("was"), "changed")
    return both.withColumn("fault", fault).filter("fault is not null").select("file", "fault")


def receipt(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """One row (rows, identity): a hash of the content that doesn't depend on row order or on the named columns.

    Rows are hashed over the JSON of their columns by name, in which no two rows that differ are alike; the identity
    hashes the count and four sums of the rows' digest parts, so it is one small aggregate."""
    cols = sorted(c for c in df.columns if c not in (drop or []))
    h = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 14 * k, 14), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    g = df.agg(F.count("*").alias("rows"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    return g.select("rows", F.sha2(F.concat_ws("|", F.lit(",".join(cols)), F.col("rows").cast("string"), *[F.col(f"p{k}").cast("string") for k in range(4)]), 256).alias("identity"))


def canonical_receipt(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """receipt() over each row's canonical JSON: the order of columns, of rows and of the keys inside structs and maps
    doesn't matter, and time-varying columns can be left out."""
    cols = sorted(c for c in df.columns if c not in (drop or []))
    rows = df.select(canonical(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("row"))
    return receipt(rows)


def resume(df: DataFrame, done: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows not done yet, dealt to shards by key; null keys are equal to each other."""
    return _unseen(df, done, [key]).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))


def write_remaining(df: DataFrame, path: str, key: str, shards: int) -> None:
    """resume() against what a path holds, appended below it in folders by shard; a repeated run writes nothing. Keys are
    unique in df, null among them; a key's shard never changes."""
    done = _written(df.sparkSession, path)
    done = df.select(key).limit(0) if done is None else done.select(key)
    from decisa.session import materialize

    left = materialize(resume(df, done, key, shards), "remaining")  # the folder is read to the end before it grows
    if not left.isEmpty():
        left.write.mode("append").partitionBy("shard").parquet(path)


def markdown(df: DataFrame, order: list, most: int = 50) -> str:
    """A short ranked table as Markdown; `most` bounds what reaches the driver."""
    rows = df.orderBy(*order).limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)
