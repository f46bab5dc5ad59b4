"""Alignment of two tokenizers' tokens over the same bytes.

Texts are encoded by both, and each id's bytes give every token its byte range. Where tokens of both sides end at one
byte, a group ends. For the tokens of a batch, pandas.merge_asof, keyed by document, finds the other side's token that
covers each token's start; the union of both directions is every pair of tokens that overlap, as of two that do, one
starts within the other. How often a pair of ids is linked is counted over all documents, and joined to each one's links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisa.llm.encoders import PieceEncoder, SpacedEncoder
from decisa.llm.words import CACHES, groups, tidy
from decisa.session import materialize, own_batches

#: Bytes of text that are encoded together, and tokens of one side that are aligned together; a longer text is encoded
#: alone and aligned in ranges of whole groups.
TEXT_BYTES, TOKENS = 1 << 20, 1 << 18
#: The pairs of ids that are broadcast to the links at most: those linked most often. No other pair holds more than a
#: FREQUENT-th of all links, and these are joined by a shuffle.
FREQUENT = 200_000

_encoders: dict = {}
CACHES.append(_encoders)


class _Side:
    """One tokenizer: its encoder, and the bytes and decimal digits of each id as flat arrays."""

    def __init__(self, encoder):
        self.encoder = encoder
        tokens = encoder.token_bytes()
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.array([len(d) for d in digits], np.int64)
        self.written = np.frombuffer(b"".join(d.ljust(8) for d in digits), np.uint8).reshape(-1, 8)

    def spells(self, ids: np.ndarray, text: np.ndarray) -> bool:
        """Whether the ids' bytes, joined, are the text's."""
        size = self.size[ids]
        if int(size.sum()) != len(text) or not size.all():
            return False
        at = np.arange(len(text)) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return bool(np.array_equal(self.flat[at], text))


def _sides(paths: tuple[str, str]) -> tuple[_Side, _Side]:
    """Both tokenizers, with what they have learnt, for all tasks of a Python worker."""
    if paths not in _encoders:
        _encoders[paths] = _Side(SpacedEncoder(paths[0])), _Side(PieceEncoder(paths[1]))
    return _encoders[paths]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of a, row of b) of tokens that overlap. Both tables have doc and at, the start of each token, in
    ascending order; the tokens of a document's two sides fill the same bytes without gaps."""
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    over = pd.merge_asof(a, b.rename(columns={"at": "start"}), left_on="at", right_on="start", by="doc")
    back = pd.merge_asof(b, a.rename(columns={"at": "start"}), left_on="at", right_on="start", by="doc")
    back = back[back["at"] != back["start"]]  # equal starts are in both directions
    return np.concatenate([over["a"], back["a"]]), np.concatenate([over["b"], back["b"]])


def written(sides: tuple[_Side, _Side], a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups as `a1,a2|b1;a3|b2,b3;`, with a mark after the last one, and the bytes up to each token. group_a and group_b
    number each token's group."""
    n = len(a) + len(b)
    at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    rows, digits, group = np.empty((n, 8), np.uint8), np.empty(n, np.int64), np.empty(n, np.int64)
    for at, ids, side, of in ((at_a, a, sides[0], 2 * group_a), (at_b, b, sides[1], 2 * group_b + 1)):
        rows[at], digits[at], group[at] = side.written[ids], side.digits[ids], of
    last = np.append(group[1:] != group[:-1], True)
    rows[np.arange(n), digits] = np.where(last, np.where(group % 2 == 0, ord("|"), ord(";")), ord(","))
    return rows[np.arange(8) <= digits[:, None]].tobytes(), np.concatenate(([0], np.cumsum(digits + 1)))


def _slices(common: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of both sides' tokens of whole groups, of about TOKENS tokens, or one longer group."""
    upto_a, upto_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
    at, a0, b0 = 0, 0, 0
    while at < len(common):
        to = max(at + 1, int(np.searchsorted(upto_a, a0 + TOKENS, "right")))
        a1, b1 = int(upto_a[to - 1]), int(upto_b[to - 1])
        yield a0, a1, b0, b1
        at, a0, b0 = to, a1, b1


def align_texts(sides: tuple[_Side, _Side], texts: list[bytes]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each text: numbers of tokens, groups and links, and the groups' digest; and its linked pairs of ids (text,
    a << 32 | b, times) in the order of texts, each pair once, but for texts of several slices."""
    some = [i for i, t in enumerate(texts) if t]
    full = [b" " + texts[i] for i in some]
    ids = [side.encoder([texts[i] for i in some]) for side in sides]
    good = []
    for k in range(len(some)):
        text = np.frombuffer(full[k], np.uint8)
        if all(side.spells(of[k], text) for side, of in zip(sides, ids, strict=True)):
            good.append(k)
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    hashes = {some[k]: hashlib.sha256() for k in good}
    if not good:
        return out, [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = np.array([some[k] for k in good])
    tokens = [np.concatenate([of[k] for k in good]).astype(np.int64) for of in ids]
    counts = [np.array([len(of[k]) for k in good]) for of in ids]
    ends = [np.cumsum(side.size[t]) for side, t in zip(sides, tokens, strict=True)]  # over the joined texts
    starts = [e - side.size[t] for e, side, t in zip(ends, sides, tokens, strict=True)]
    common = ends[0][np.isin(ends[0], ends[1], assume_unique=True)]
    owner = [np.repeat(docs, c) for c in counts]
    out["n_a"][docs], out["n_b"][docs] = counts
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pending: dict[int, bytes] = {}
    second = len(sides[1].size)
    for a0, a1, b0, b1 in _slices(common, *ends):
        a, b, own, own_b = tokens[0][a0:a1], tokens[1][b0:b1], owner[0][a0:a1], owner[1][b0:b1]
        x, y = overlaps(pd.DataFrame({"doc": own, "at": starts[0][a0:a1]}), pd.DataFrame({"doc": own_b, "at": starts[1][b0:b1]}))
        out["n_links"] += np.bincount(own[x], minlength=n)
        group_a, group_b = np.searchsorted(common, ends[0][a0:a1]), np.searchsorted(common, ends[1][b0:b1])
        out["n_groups"] += np.bincount(own[np.append(True, group_a[1:] != group_a[:-1])], minlength=n)
        text, upto = written(sides, a, b, group_a, group_b)
        here = np.unique(own)
        stops = upto[np.searchsorted(own, here, "right") + np.searchsorted(own_b, here, "right")].tolist()
        for doc, start, stop in zip(here.tolist(), [0, *stops], stops, strict=False):
            if doc in pending:
                hashes[doc].update(pending[doc])
            hashes[doc].update(text[start : stop - 1])
            pending[doc] = text[stop - 1 : stop]  # the mark between two groups; the last one has none after it
        found.append(np.unique((own[x] * len(sides[0].size) + a[x]) * second + b[y], return_counts=True))
    keys, times = (np.concatenate(c) for c in zip(*found, strict=True))
    of, pair = np.divmod(keys, len(sides[0].size) * second)
    pair = (pair // second << 32) | pair % second
    return out, [hashes[i].hexdigest() if i in hashes else "" for i in range(n)], of, pair, times


def aligned(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, links): the alignment of each whole text.

    byte_path is a tokenizers file of byte-level BPE (a), piece_path a sentencepiece model (b) that adds a space of its
    own. Both encode a space and the text, without special tokens, whose strings are ordinary text. A text that is null,
    empty, or that the ids of either side don't spell byte for byte has no tokens: zeros, an empty digest, no links.
    links: array of (pair, times) of pairs of ids, a << 32 | b. row numbers the rows; it and the links are
    written once. Rows of one key stand for themselves."""
    schema = pa.schema([("row", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides = _sides((byte_path, piece_path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in groups(texts, TEXT_BYTES):
                numbers, digests, of, pair, times = align_texts(sides, [t or b"" for t in texts[low:high]])
                stops = np.searchsorted(of, np.arange(high - low + 1)).astype(np.int32)
                links = pa.ListArray.from_arrays(pa.array(stops), pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"]))
                rows = pa.array(np.arange(row, row + high - low))
                row += high - low
                columns = [rows, *[pa.array(numbers[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests), links]
                yield pa.RecordBatch.from_arrays([keys.slice(low, high - low), *columns], names=["key", *schema.names])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    out = rows.mapInArrow(tidy(run, _encoders), f"key {key_type}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>")
    with own_batches(docs.sparkSession):
        return materialize(out, "alignment")


def _second(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << 32) - 1))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold each pair of ids, and whether none with its b is more frequent."""
    counts = materialize(links.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    most = counts.groupBy(_second(F.col("pair")).alias("b")).agg(F.max("count").alias("most"))  # a row an id
    joined = counts.withColumn("b", _second(F.col("pair"))).join(F.broadcast(most), "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_statistics(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """aligned() rows with n_best, the links whose pair is their b's most frequent one, and count_sum, the sum of all
    links' counts, instead of links.

    The up to `frequent` most frequent pairs are broadcast; a link of another pair, which holds a small share of all
    links, meets its count by a shuffle."""
    links = rows.select("row", F.inline("links"))
    counts = materialize(pair_counts(links), "counts")
    top = counts.orderBy(F.desc("count")).limit(frequent + 1).agg(F.count("*").alias("n"), F.min("count").alias("floor")).first()
    floor = top["floor"] if top["n"] > frequent else 0  # fewer than `frequent` + 1 pairs are above it
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    common = counts.filter(F.col("count") > floor)
    parts = [links.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)]
    if floor:
        rare = links.join(F.broadcast(common.select("pair")), "pair", "left_anti")
        parts.append(rare.join(counts.filter(F.col("count") <= floor).hint("shuffle_hash"), "pair").groupBy("row").agg(*sums))
    own = [c for c in rows.columns if c not in ("row", "links")]
    nothing = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
    every = rows.select("row", F.struct(*own).alias("own"), *nothing)
    for part in parts:
        every = every.unionByName(part.select("row", F.lit(None).cast(every.schema["own"].dataType).alias("own"), "n_best", "count_sum"))
    out = every.groupBy("row").agg(F.first("own", True).alias("own"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("own.*", "n_best", "count_sum")


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row; see aligned() for texts without
    tokens, whose numbers are all 0. Columns beside key and text are not read, so their names don't matter. An empty
    table gives none. A text longer than TEXT_BYTES is encoded alone, in memory of a small multiple of its size, and
    aligned in ranges of whole groups."""
    out = link_statistics(aligned(docs, byte_path, piece_path, key, text), frequent)
    return out.withColumnRenamed("key", key)
