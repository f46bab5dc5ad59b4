"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed features: words, word bigrams, byte n-grams inside words, and
marks for a word that repeats one of its last three. A softmax layer scores the average. Vectors and layer are trained
together by numpy stochastic gradient descent on a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisa.llm.words import U64, Block, groups, mix, segments, tidy
from decisa.session import short_batches

#: Labelled rows that a model is fitted on at most: those whose hashed ids are smallest, so any size of table gives
#: the same kind of sample. Their whole texts are about 13 MB here.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 16
DIM = 8
#: Steps of the descent: small samples are gone through more often.
STEPS = 20_000
RATE = 0.5
GRAMS = (2, 3, 4)
#: Bytes of text whose features are in memory at once, about 150 bytes for each byte.
PIECE = 1 << 19
REPEATS = 3
#: Texts that score less are rejected.
KEEP = 0.7


def _features(b: Block, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block, and the place in bytes that each one starts at. owner is the text of each piece;
    bigrams and repeats take both words from one text."""
    words, text = b.words(), np.repeat(owner, b.counts)
    out, at = [words + U64(1)], [b.starts]
    if len(words) > 1:
        pair = np.flatnonzero(text[1:] == text[:-1])
        out.append(words[pair] * U64(0x9E3779B97F4A7C15) + words[pair + 1] + U64(2))
        at.append(b.starts[pair])
    for k in range(1, REPEATS + 1):
        again = np.flatnonzero((words[k:] == words[:-k]) & (text[k:] == text[:-k])) + k
        out.append(np.full(len(again), k, U64))
        at.append(b.starts[again])
    inside = np.concatenate(([0], np.cumsum(b.space)))
    for n in GRAMS:
        if len(b.bytes) > n:
            start = np.flatnonzero(inside[n:] == inside[:-n])
            out.append(b.hashes(start, start + n) + U64(3))
            at.append(start)
    return mix(np.concatenate(out)) & U64(BUCKETS - 1), np.concatenate(at)


def _by_text(texts: list[bytes | None]):
    """(features, text index of each) in blocks; bigrams and repeats don't cross blocks of long texts."""
    for a, z in groups(texts, PIECE):
        pieces, owner = [], []
        for i in range(a, z):
            for piece in segments(texts[i] or b"", PIECE):
                pieces.append(piece)
                owner.append(i)
        size = sum(map(len, pieces))
        for lo, hi in ((0, len(pieces)),) if size <= 2 * PIECE else ((k, k + 1) for k in range(len(pieces))):
            b, of = Block(pieces[lo:hi], lower=False), np.asarray(owner[lo:hi])
            f, at = _features(b, of)
            yield f.astype(np.int32), of[np.searchsorted(b.offsets, at, "right") - 1]


def train(texts: list[bytes], labels: np.ndarray, classes: int = 2, seed: int = 1) -> dict[str, np.ndarray]:
    """Vectors (BUCKETS, DIM), layer (DIM, classes) and bias by SGD, one text a step, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    bags: list[list[np.ndarray]] = [[] for _ in texts]
    for f, owner in _by_text(texts):
        order = np.argsort(owner, kind="stable")
        f, owner = f[order], owner[order]
        cut = np.flatnonzero(np.diff(owner)) + 1
        for part, i in zip(np.split(f, cut), owner[np.concatenate(([0], cut))] if len(owner) else [], strict=False):
            bags[i].append(part)
    docs = [np.unique(np.concatenate(p), return_counts=True) if p else None for p in bags]
    usable = [i for i, d in enumerate(docs) if d is not None]
    vectors = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    layer, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    epochs, done = max(1, -(-STEPS // max(1, len(usable)))), 0
    steps = epochs * len(usable)
    for _ in range(epochs):
        for i in rng.permutation(usable):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            ids, n = docs[i]
            share = (n / n.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            # a feature's step is scaled by its share of the text; the sum over features keeps the rate
            vectors[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back
    return {"vectors": vectors, "layer": layer, "bias": bias}


def constant(good: bool) -> dict[str, np.ndarray]:
    """The model of a table with one class or none."""
    return {"vectors": np.zeros((1, DIM), np.float32), "layer": np.zeros((DIM, 2), np.float32), "bias": np.array([0, 9 if good else -9], np.float32)}


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Train on the texts of a bounded sample of labels (key, label), in one task; the model is about 2 MB.

    docs: (key, text). A key with several texts gives its smallest; null keys, texts and labels teach nothing. With one class
    or no label at all, the model always gives that class, or 1.
    """
    ids = labels.filter("key is not null and label in (0, 1)").orderBy(F.xxhash64("key"), "key").limit(rows)
    sample = docs.filter("text is not null").join(F.broadcast(ids), "key").groupBy("key", "label").agg(F.min("text").alias("text")).repartition(1)

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        table = pa.concat_tables(tables) if tables else None
        table = table and table.sort_by("key")
        texts, labels = (table.column("text").to_pylist(), table.column("label").to_numpy().astype(int)) if table else ([], np.zeros(0, int))
        model = train(texts, labels) if len(set(labels.tolist())) > 1 else constant(not len(labels) or labels[0] == 1)
        yield pa.RecordBatch.from_pylist([{"name": k, "shape": list(v.shape), "data": v.astype(np.float32).tobytes()} for k, v in model.items()], schema=pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())]))

    got = sample.select("key", F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label")).mapInArrow(tidy(run), "name string, shape array<long>, data binary").collect()
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in got} or constant(True)


def scorer(model: dict[str, np.ndarray]):
    """A Series of binary texts -> the probability of label 1. The layer is linear in the average, so each feature's
    vector is applied once to the layer and a text averages those numbers."""
    weights = (model["vectors"] @ (model["layer"][:, 1] - model["layer"][:, 0])).astype(np.float64)
    bias = float(model["bias"][1] - model["bias"][0])
    if len(weights) < BUCKETS:
        weights = np.zeros(BUCKETS)

    def score(texts: list[bytes | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for f, owner in _by_text(texts):
            total += np.bincount(owner, weights[f], len(texts))
            n += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))

    return score


def score_of(text, model: dict[str, np.ndarray]):
    """A column: the probability of good quality from the whole text alone."""
    score = scorer(model)

    def run(batches):
        for texts in batches:
            yield pd.Series(score(texts.tolist()))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    return of(text.cast("binary"))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs with score. Null and empty texts get the model's score of no features. A column named score is replaced;
    other columns and repeated rows stay; an empty table stays empty."""
    short_batches(docs.sparkSession)
    return docs.drop("score").withColumn("score", score_of(F.col("text"), model))


def accepted(docs: DataFrame, model: dict[str, np.ndarray], keep: float = KEEP) -> DataFrame:
    """The rows of docs that score keep or more, with just their own columns. Null and empty texts stay: there is
    nothing in them to reject."""
    short_batches(docs.sparkSession)
    empty = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    return docs.filter(empty | (score_of(F.col("text"), model) >= keep))


def learnable(labels: DataFrame, column: str = "quality", folds: int = 4, out: int = 2) -> DataFrame:
    """(key, label) of labels outside the held-out fold, which is never learnt from; one label for each doc_id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return labels.filter(fold != out).groupBy(F.col("doc_id").alias("key")).agg(F.max(column).alias("label"))
