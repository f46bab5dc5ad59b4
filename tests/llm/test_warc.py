import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from decisa.llm import warc
from decisa.session import fresh_path


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


PAGES = [
    (5, "http://b.example.com/x?q=1", "same"), (3, "http://a.example.com/", "same"), (9, "https://a.example.com/z#f", "same"),
    (1, None, None), (2, "no scheme", ""), (7, "http://A.example.com/\r\ninjected", "WARC/1.1\r\n\r\n\r\n\r\nx"), (8, "http://c.org", "\u00e9\u4e2d" * 3000), (7, "http://A.example.com/2", "other"), (None, "http://n.org/", "same"),
]


def expected(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by plain loops: one response a payload."""
    want, seen = [], {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0, p[1] or "")):
        data = (h or "").encode()
        first = data in seen
        want.append((i, len(data), digest(data), "revisit" if first else "response", seen.get(data)))
        seen.setdefault(data, i)
    return sorted(want, key=str)


REPEATED = [(3, "http://a.example.com/", "same"), (3, "http://a.example.com/", "same"), (3, "http://0.org/", "same"), (None, None, "only null ids"), (None, "x://y", "only null ids"), (20, "u", "z"), (20, "u", "z"), (20, "u", "other")]


@pytest.mark.parametrize("rows", [PAGES, PAGES + REPEATED])
@pytest.mark.parametrize("broadcast", [300_000, 1])
@pytest.mark.parametrize("files", [warc.FILES, ((900, 2), (19_000, 2), (1 << 62, 1))])
def test_round_trip_and_revisits(spark, monkeypatch, rows, broadcast, files):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(warc, "FILES", files)
    monkeypatch.setattr(warc, "CHUNK", 3)
    df = spark.createDataFrame([(*p, "clash", 1) for p in rows], "page_id long, url string, html string, digest string, first int").repartition(3)
    got = warc.archive_pages(df).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))


def test_files_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((1000, 4), (20_000, 1), (1 << 62, 1)))
    pages = [(i, "u", str(i) * (9000 if i % 10 == 0 else 20)) for i in range(40)] + [(99, "u", "y" * 100_000)]
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    sizes = [r["length"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert sorted(s > 4000 for s in sizes).count(True) == 5 and max(s for s in sizes if s < 100_000) < 20_000


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.archive_pages(df, min_bytes=5).collect()} == {"response"}


def test_order_is_global_over_urls_and_times(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    rng = random.Random(4)
    pages = [(i, f"http://h{rng.randrange(3)}.com/{rng.randrange(20)}", "x" * i, rng.choice([f"2024-01-{d:02}T00:00:00Z" for d in (1, 2, 9)])) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, at string").repartition(7)
    merged = warc.archive_pages(df, ranges=6, date=F.col("at"))
    rows = merged.orderBy("range", "position").collect()
    keys = [(r["url_key"], r["timestamp"], r["page_id"]) for r in rows]
    assert keys == sorted(keys) and len({r["range"] for r in rows}) > 3 and [r["rank"] for r in rows] == list(range(1, 301))
    assert {(r["page_id"], r["timestamp"]) for r in rows} == {(p[0], p[3]) for p in pages}
    times = [[k[1] for k in keys if k[0] == u] for u in {k[0] for k in keys}]
    assert any(len(set(t)) > 1 for t in times)


def test_runs_are_stored_in_order(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 7}.com/{-i}", str(i)) for i in range(50)], "page_id long, url string, html string").repartition(3)
    path = fresh_path(spark, "warc")
    warc.write_warc(df, path)
    runs = warc.read_runs(spark, path).collect()
    assert len(runs) > 1 and all([warc._key(c.asDict()) for c in r["captures"]] == sorted(warc._key(c.asDict()) for c in r["captures"]) for r in runs)


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_loser_tree():
    rng = random.Random(5)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(12))) for _ in range(k)]
        assert [runs[i][j] for i, j in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)
