"""WARC output, reading back, and a capture index merged from sorted runs.

Writing is text tables whose line separator is the end of a WARC record, so Spark's own writer puts whole records into
files of any store; files are bounded in bytes. Reading takes each file's bytes and walks its records by
Content-Length; a file's captures are sorted by ORDER and stored as a run, in chunks. Runs are cut at common range
bounds, and a task merges the cuts of one range, which are in order already, with a loser tree. So ranges in order are
one globally ordered capture history.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.llm.words import tidy
from decisa.session import fresh_path, materialize, own_batches

RECORD_END = "\r\n\r\n"
#: (largest record in bytes, records in a file): at most 32 MB a file but for a larger record, which has its own.
FILES = ((1 << 14, 2048), (1 << 18, 128), (1 << 22, 8), (1 << 62, 1))
#: Bytes of a record beside its URL and payload, at most.
HEAD = 700
#: Digests of repeated payloads (50 bytes each), the most repeated ones, that are broadcast; the others are joined by a
#: shuffle, and none of them has more than a BROADCAST_ROWS-th of all rows.
BROADCAST_ROWS = 300_000
#: Captures of a stored chunk of a run, and of a range of the merge, about.
CHUNK, RANGE = 1024, 50_000
DATE = "2024-01-01T00:00:00Z"
ORDER = ("url_key", "timestamp", "page_id", "payload_digest", "record_type")
CAPTURE = pa.struct([("page_id", pa.int64()), ("url_key", pa.string()), ("timestamp", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64())])
CAPTURES = "captures array<struct<page_id: bigint, url_key: string, timestamp: string, record_type: string, payload_bytes: bigint, payload_digest: string, refers_to: bigint, offset: bigint>>"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """Host labels reversed and joined by commas, then `)` and the rest: URLs of one site sort together."""
    _, scheme, rest = url.partition("://")
    if not scheme:
        return url
    authority = re.match(r"[^/?#]*", rest).group()
    host = authority.partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + rest[len(authority) :].partition("#")[0]


def _records(rows: DataFrame, min_bytes: int) -> tuple[DataFrame, int]:
    """rows (page_id, url, html, date, size, digest) with first (the response's page_id, where others repeat the
    payload) and revisit; a revisit's html is empty. And the bytes of the largest record."""
    narrow = materialize(rows.select("page_id", "digest", "size", F.octet_length("url").alias("url_bytes")), "payloads")
    firsts = narrow.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1")
    firsts = materialize(firsts, "repeated-payloads")
    # a first page_id may stand in several rows, of which one is the response
    hot = F.broadcast(firsts.orderBy(F.desc("times"), "digest").limit(BROADCAST_ROWS).select(F.col("digest").alias("h"), F.col("first").alias("hot_first"), F.lit(True).alias("is_hot")))
    cold = firsts.join(hot, F.col("digest") == F.col("h"), "leftanti").select(F.col("digest").alias("c"), F.col("first").alias("cold_first"), F.lit(True).alias("is_cold"))

    def placed(table: DataFrame) -> DataFrame:
        out = table.join(hot, F.col("digest") == F.col("h"), "left")
        if firsts.count() > BROADCAST_ROWS:
            key = F.when(F.col("is_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
            out = out.withColumn("k", key).join(cold, F.col("k") == F.col("c"), "left")
        else:
            out = out.withColumns({"cold_first": F.lit(None).cast("long"), "is_cold": F.lit(None).cast("boolean")})
        out = out.withColumns({"first": F.coalesce("hot_first", "cold_first"), "repeated": F.col("is_hot").isNotNull() | F.col("is_cold").isNotNull()})
        out = out.withColumn("leads", ~F.col("repeated") | F.col("page_id").eqNullSafe(F.col("first")))
        return out.drop("h", "hot_first", "is_hot", "c", "cold_first", "is_cold", "k")

    twice = placed(narrow).filter("repeated and leads").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    twice = materialize(twice, "repeated-rows")
    largest = (narrow.agg(F.max(F.col("size") + F.col("url_bytes"))).first()[0] or 0) + HEAD
    rows = placed(rows)
    revisit = rows.withColumn("revisit", ~F.col("leads"))
    out = revisit.withColumn("html", F.when(F.col("revisit"), "").otherwise(F.col("html")))
    if not twice.isEmpty():
        again = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
        own = out.filter("repeated and leads").join(again, "digest", "leftsemi")
        same = materialize(own.drop("html").withColumn("row", F.monotonically_increasing_id()), "same-rows")
        lead = same.groupBy("digest").agg(F.min(F.struct("url", "date", "row")).alias("lead"))
        payload = own.groupBy("digest").agg(F.first("html").alias("html"))  # equal ones
        leads = same.join(lead.select("lead.row"), "row").drop("row").join(payload, "digest")
        others = same.join(lead.select("lead.row"), "row", "leftanti").drop("row").withColumns({"revisit": F.lit(True), "html": F.lit("")})
        out = out.filter("not (repeated and leads)").unionByName(out.filter("repeated and leads").join(again, "digest", "leftanti")).unionByName(leads).unionByName(others)
    return out, largest


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: Column | str = DATE) -> None:
    """A WARC record for every row of pages (page_id, url, html), captured at `date`.

    The payload is the html in UTF-8; null is empty. Of the rows with equal payloads of min_bytes or more, one with the
    smallest page_id (null last; of several such rows one with the smallest URL) is a response, the others are revisits
    that name its page_id and carry no payload, only its digest and length; smaller payloads are all responses. A line
    break in a URL is written as %0A or %0D. Other columns are not read. An empty table writes no record.
    """
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\n", "%0A"), "\r", "%0D")
    at = F.lit(date) if isinstance(date, str) else F.coalesce(date, F.lit(DATE))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html"), at.alias("date"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    rows, largest = _records(rows, min_bytes)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">\r\nX-Payload-Length: "), F.col("size").cast("string"))),
        F.concat(F.lit("Content-Type: text/html;charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string")),
    )
    records, least = rows.select(F.concat(head, F.lit(RECORD_END), F.col("html")).alias("value")), -1
    for most, n in FILES:
        some = records if least < 0 and largest <= most else records.filter(F.octet_length("value").between(least + 1, most))
        some.write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", n).text(path)
        if largest <= most:
            break
        least = most


def parse_warc(data: bytes):
    """(headers, payload, offset) of each record of a WARC file."""
    at, end = 0, RECORD_END.encode()
    while at < len(data):
        stop = data.index(end, at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        start = stop + len(end)
        yield headers, data[start : start + size], at
        at = start + size + len(end)


def _id(text: str | None) -> int | None:
    number = (text or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _key(capture: dict) -> tuple:
    return (capture["url_key"], capture["timestamp"], -1 if capture["page_id"] is None else capture["page_id"], capture["payload_digest"], capture["record_type"])


def read_runs(spark, path: str) -> DataFrame:
    """(file, chunk, captures): the captures of every file, sorted by ORDER; chunks in order are the file's run."""
    schema = pa.schema([("file", pa.string()), ("chunk", pa.int32()), ("captures", pa.list_(CAPTURE))])

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                file, data, rows = b.column(0)[i].as_py(), b.column(1)[i].as_py(), []
                for headers, payload, offset in parse_warc(data):
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if not revisit and headers["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
                    rows.append({
                        "page_id": _id(headers["WARC-Record-ID"]), "url_key": url_key(headers["WARC-Target-URI"]), "timestamp": headers["WARC-Date"], "record_type": headers["WARC-Type"],
                        "payload_bytes": int(headers["X-Payload-Length"]) if revisit else len(payload),
                        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest,
                        "refers_to": _id(headers.get("WARC-Refers-To")), "offset": offset,
                    })
                rows.sort(key=_key)
                for k, a in enumerate(range(0, len(rows), CHUNK)):
                    yield pa.RecordBatch.from_pylist([{"file": file, "chunk": k, "captures": rows[a : a + CHUNK]}], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), f"file string, chunk int, {CAPTURES}")


class LoserTree:
    """Merges k sorted lists of keys: an inner node keeps the loser of its match, the winner moves up, and after each
    item only the matches on its list's path to the root are played again."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        """Whether run i's next key comes before run j's; a run at its end never does; ties go to the first run."""
        if self.at[i] >= len(self.runs[i]):
            return False
        if self.at[j] >= len(self.runs[j]):
            return True
        a, b = self.runs[i][self.at[i]], self.runs[j][self.at[j]]
        return a < b or (a == b and i < j)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        """(run, index in it) in merged order."""
        for _ in range(sum(map(len, self.runs))):
            i = self.tree[0]
            yield i, self.at[i]
            self.at[i] += 1
            self._play(i)


def _bounds(runs: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut all captures into about equal ranges: quantiles of a sample of 32 keys a range, by hash."""
    capture = runs.select(F.explode("captures").alias("c"))
    key = F.struct(*[F.coalesce(F.col(f"c.{k}"), F.lit(-1)).alias(k) if k == "page_id" else F.col(f"c.{k}").alias(k) for k in ORDER])
    some = capture.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(32 * ranges)
    cut = some.withColumn("tile", F.ntile(ranges).over(Window.orderBy("key"))).groupBy("tile").agg(F.min("key").alias("bound")).filter("tile > 1")
    return sorted({tuple(r["bound"]) for r in cut.collect()})  # fewer than ranges rows


def _cut(bounds: list[tuple]):
    """Chunks of runs -> pieces of one range each, in order as the chunk is."""
    schema = pa.schema([("range", pa.int32()), ("file", pa.string()), ("chunk", pa.int32()), ("n", pa.int64()), ("captures", pa.list_(CAPTURE))])

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                captures, keys = b.column(2)[i].values, [_key(c) for c in b.column(2)[i].as_py()]
                at = 0
                while at < len(keys):
                    k = bisect.bisect_right(bounds, keys[at])
                    end = bisect.bisect_left(keys, bounds[k], at) if k < len(bounds) else len(keys)
                    piece = pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), captures.slice(at, end - at))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b.column(0)[i].as_py()]), pa.array([b.column(1)[i].as_py()], pa.int32()), pa.array([end - at]), piece], schema=schema)
                    at = end

    return run


MERGED = "page_id long, url_key string, timestamp string, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, file string, range int, position long"


def _merge(pieces: pa.Table) -> pa.Table:
    """The pieces of one range, merged by a loser tree over files; a file's pieces in order of chunks are one sorted list."""
    pieces = pieces.sort_by([("file", "ascending"), ("chunk", "ascending")]).combine_chunks()
    captures = pieces["captures"].combine_chunks()
    size, files = captures.value_lengths().to_pylist(), pieces["file"].to_pylist()
    flat = captures.flatten()
    keys = [_key(c) for c in flat.to_pylist()]
    starts, of, at = [], [], 0
    for k, n in enumerate(size):
        if not k or files[k] != files[k - 1]:
            starts.append(at)
        of += [files[k]] * n
        at += n
    lists = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    order = pa.array([starts[i] + k for i, k in LoserTree(lists)], pa.int64())
    merged = flat.take(order)
    columns = {f.name: merged.field(f.name) for f in CAPTURE}
    columns |= {"file": pa.array(of, pa.string()).take(order), "range": pa.array([pieces["range"][0].as_py()] * len(keys), pa.int32()), "position": pa.array(range(len(keys)), pa.int64())}
    return pa.table(columns)


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """All captures with range, position in it, and rank: their global order by ORDER, from 1.

    Bounds are quantiles of a sample of keys, the URL key with the time, the record id and the rest of ORDER, so
    captures of one URL may spread over ranges. What meets in one task are the cuts of a range.
    """
    pieces = materialize(runs.mapInArrow(tidy(_cut(_bounds(runs, ranges))), f"range int, file string, chunk int, n long, {CAPTURES}"), "pieces")
    sizes = pieces.groupBy("range").agg(F.sum("n").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("range", before.alias("before")))
    merged = pieces.groupBy("range").applyInArrow(_merge, MERGED)
    return merged.join(sizes, "range").withColumn("rank", F.col("before") + F.col("position") + 1).drop("before")


def archive_pages(pages: DataFrame, min_bytes: int = 0, ranges: int | None = None, date: Column | str = DATE) -> DataFrame:
    """Write pages as WARC into the shared folder, read the archives back and merge their index.

    (range, page_id, url_key, timestamp, record_type, payload_bytes, payload_digest, refers_to, offset, file, position,
    rank), a row for every page; none for an empty table. Columns of pages but page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes, date)
    with own_batches(spark, 100):
        runs = materialize(read_runs(spark, path), "captures")
    total = runs.agg(F.sum(F.size("captures"))).first()[0] or 0
    return merge_runs(runs, ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE)))
