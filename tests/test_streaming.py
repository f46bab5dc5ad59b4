"""Batch and streaming forms give the same rows."""

import random

from pyspark.sql import functions as F

from decisa.operators.asof import asof_join
from decisa.streaming import windows
from decisa.streaming.asof import stream_asof


def test_stream_equals_the_batch_join(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), t // 3, rng.choice(["fact", "ask", "ask"]), float(t)) for t in range(240)]
    df = spark.createDataFrame(rows, "key string, t long, kind string, value double")
    for k in range(4):
        df.filter(f"t >= {k * 20} and t < {k * 20 + 20}").coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_asof(source).writeStream.format("memory").queryName("asof").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["key"], r["t"], -1 if r["value"] is None else r["value"] // 3, r["age"] is None) for r in spark.table("asof").collect())
    asks, facts = df.filter("kind = 'ask'").select("key", "t"), df.filter("kind = 'fact'").select("key", "t", "value")
    batch = asof_join(asks, facts, ["key"], "t", "t", ["value"]).collect()
    assert got == sorted((r["key"], r["t"], -1 if r["value"] is None else r["value"] // 3, r["value"] is None) for r in batch) and len(got) > 100


def test_windows_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", "view", 1.0, k % 2) for k in range(60)]
    e = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double, user_id int").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value", "user_id")
    e.write.parquet(str(tmp_path / "e"))
    s = windows.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "10 minutes")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windows.windowed(e, "10 minutes").collect()))
    assert windows.sessions(e, "3 minutes").count() == 2


def test_expiring_counters(spark, tmp_path):
    from decisa.streaming.counters import stream_counters

    rng, base = random.Random(7), 1_700_000_000
    rows = [(rng.choice("abc"), k, base + k // 2, None if k % 19 == 0 else rng.choice([-1.0, 2.0, 0.5])) for k in range(300)]
    mixed = sorted(rows, key=lambda r: r[2] + rng.randrange(20))
    schema = "user string, id long, s long, value double"
    for k in range(3):
        spark.createDataFrame(mixed[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    spark.createDataFrame([("z", -1, base + 10_000, 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/part9"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    q = stream_counters(source, "user", "id", "ts", "value", 15, "30 seconds").writeStream.format("memory").queryName("counters").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counters").filter("id >= 0").collect()
    df = spark.createDataFrame([(*r[:3], r[3] or 0.0) for r in rows], schema)
    batch = windows.rolling_counters(df, ["user"], "s", 15, "value").collect()
    assert sorted((r["user"], r["id"], r["second"], r["orders"], r["turnover"]) for r in got) == sorted((r["user"], r["id"], r["s"], r["orders"], r["turnover"]) for r in batch)
    most = max(sum(1 for r in rows if r[0] == u and s < r[2] <= s + 15 + 30 + 50 + 20) for u in "abc" for s in range(base - 20, base + 150))
    assert max(r["held"] for r in got) <= most


def test_daily_book_of_closed_dates(spark, tmp_path):
    from decisa.operators.panel import daily_ledger
    from decisa.streaming.daybook import LEDGER, decide_closed, stream_daily_book

    rng = random.Random(8)
    rows = [(a, d, rng.choice([0.0, 1.0, 2.0, 3.0, 4.5]) + rng.random()) for d in range(12) for a in "abcdefgh" if rng.random() < 0.85 or d in (0, 11)]
    order = sorted(rows, key=lambda r: r[1] + rng.random() * 2.5)
    schema, path = "asset string, day int, close double", str(tmp_path / "book")
    parts = [order[k::1][: len(order) // 3] for k in (0, len(order) // 3, 2 * (len(order) // 3))]
    parts[2] = order[2 * (len(order) // 3) :]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_daily_book(source, path, str(tmp_path / "cp"), 2, 5, 5.0).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = min(max(d for x, d, _ in rows if x == a) for a in "abcdefgh")
    want = daily_ledger(spark.createDataFrame(rows, schema).filter(f"day < {closed}"), "day", "asset", "close", "close", 2, 5, 5.0).orderBy("day").collect()
    read = lambda name, s: spark.read.schema(s).parquet(f"{path}/{name}")
    same = lambda: [[v if v is None or isinstance(v, str) else round(float(v), 6) for v in r] for r in read("ledger", LEDGER).orderBy("day").collect()]
    first = same()
    assert first == [[v if v is None or isinstance(v, str) else round(float(v), 6) for v in r] for r in want] and len(first) == closed
    decide_closed(spark.createDataFrame([("a", 99, 1.0)], schema), 1, path, 2, 5, 5.0)  # a batch of the log again
    decide_closed(spark.createDataFrame([*order[:20], ("a", 3, 77.0)], schema), 17, path, 2, 5, 5.0)  # rows again, and a late one
    assert same() == first and read("late", "asset string, day int, close double, batch long").filter("close = 77").count() == 1
    assert read("rows", schema).filter("day = 99 or close = 77").count() == 0


def test_saved_state_probe(spark, tmp_path):
    from decisa.streaming.daybook import probe

    path = str(tmp_path / "state")
    day = lambda d, gross=1.0, cost=0.5, booked=None: (d, gross, cost, booked if booked is not None else 0.5 * (d + 1))
    frame = lambda rows: spark.createDataFrame(rows, "day int, gross_bps double, cost_bps double, booked_bps double")
    found = lambda rows: sorted((r["day"], r["issue"]) for r in probe(frame(rows), path).collect())
    good = [day(d) for d in range(6)]
    assert found(good) == [] and found(good) == []
    assert found([*good, day(6)]) == []
    bad = [day(0), day(1, booked=9.0), day(2), day(4, 2.0, 1.0, 2.5), day(5, booked=float("nan")), day(6)]
    assert found(bad) == [(1, "not_resummed"), (1, "rewritten"), (3, "lost_date"), (4, "rewritten"), (5, "not_finite"), (5, "rewritten")]
    assert [(d, i) for d, i in found([*good, day(6), day(6)]) if i in ("shrunk", "new_in_past")] == [(3, "new_in_past")]
    assert (6, "shrunk") in found([*good, day(6)])
    assert spark.read.parquet(path).agg(F.max("version")).first()[0] == 6
