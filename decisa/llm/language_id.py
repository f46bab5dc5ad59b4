"""Language ID by word-first backoff.

A known word scores its log frequency in each language. A word that training never saw is read by character n-grams,
longest first: at each place the longest n-gram that training saw scores, shorter ones stand in where it did not.
Counts come from a bounded sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decisa.llm.words import U64, Block, blocks, mix, tidy
from decisa.session import materialize, short_batches

#: Labelled rows that a language is fitted on at most: those whose hashed ids are smallest.
SAMPLE_ROWS = 1500
#: Rows and bytes of text of the whole sample at most; every language has an equal part, and a row at least.
ALL_ROWS, ALL_BYTES = 300_000, 64 << 20
#: Languages whose shares are broadcast at most; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Words kept for all languages together, the most frequent ones; rarer words are read by n-grams.
WORDS = 60_000
ORDERS = (5, 4, 3, 2, 1)
#: N-grams kept of each order, the most frequent ones.
GRAMS = 40_000
SMOOTH = 0.5
BACKOFF = 0.4
LETTER = r"\p{L}"


class _Counts:
    """Counts of keys by language, one block of text after another."""

    def __init__(self, languages: int):
        self.k, self.cells = languages, []
        self.parts: list[np.ndarray] = [np.zeros(0, U64)]

    def add(self, keys: np.ndarray, langs: np.ndarray) -> None:
        known, at = np.unique(keys, return_inverse=True)
        self.parts.append(known)
        self.cells.append(np.bincount(at * self.k + langs, minlength=len(known) * self.k).reshape(len(known), self.k))

    def table(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, log frequencies by language) of the `most` frequent keys."""
        known, at = np.unique(np.concatenate(self.parts), return_inverse=True)
        counts = np.zeros((len(known), self.k))
        if len(known):
            np.add.at(counts, at, np.concatenate(self.cells))
        return _log_table(known, counts, most)


def _log_table(known: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    total = counts.sum(axis=0)
    keep = np.sort(np.argsort(-counts.sum(axis=1), kind="stable")[:most])
    return known[keep], np.log((counts[keep] + SMOOTH) / (total + SMOOTH * max(1, len(known)))).astype(np.float32)


def train(texts: list[bytes], langs: list[str]) -> dict:
    names = sorted(set(langs))
    code, k = np.array([names.index(x) for x in langs], int), max(1, len(names))
    words, grams, counted = _Counts(k), {n: _Counts(k) for n in ORDERS}, np.zeros(0, U64)
    for b, owner in blocks(texts, lower=True):
        lang, hashes = np.repeat(code[owner], b.counts), b.words()
        words.add(hashes, lang)
        pairs, first = np.unique(mix(hashes + lang.astype(U64)), return_index=True)
        first = first[~np.isin(pairs, counted, assume_unique=True)]  # n-grams count once for each word of a language
        counted = np.union1d(counted, pairs)
        chars, number = b.characters()
        at, stop = number[b.starts[first]], number[b.ends[first]]
        for n in ORDERS:
            room = np.maximum(stop - at - n + 1, 0)
            place = np.repeat(at, room) + np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
            grams[n].add(b.hashes(chars[place], chars[place + n]) + U64(n), np.repeat(lang[first], room))
    return {"names": names, "words": words.table(WORDS), **{str(n): grams[n].table(GRAMS) for n in ORDERS}}


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Row of each key in a table, -1 where it has none."""
    known = table[0]
    if not len(known):
        return np.full(len(keys), -1)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, at, -1)


def _unseen(model: dict, b: Block, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Scores of unseen words by language: the mean over characters of the longest known n-gram that starts there,
    shorter ones discounted; a character that training never saw says nothing."""
    chars, number = b.characters()
    first, last = number[starts], number[ends]
    size = last - first
    total, offset = int(size.sum()), np.cumsum(size) - size
    word = np.repeat(np.arange(len(starts)), size)
    at = first[word] + np.arange(total) - offset[word]
    out, open_ = np.zeros((total, k), np.float32), np.ones(total, bool)
    for depth, n in enumerate(ORDERS):
        place = np.flatnonzero(open_ & (at + n <= last[word]))
        row = _find(model[str(n)], b.hashes(chars[at[place]], chars[at[place] + n]) + U64(n))
        hit = row >= 0
        out[place[hit]] = model[str(n)][1][row[hit]] + depth * np.log(BACKOFF)
        open_[place[hit]] = False
    sums = np.add.reduceat(out, offset, axis=0) if total else np.zeros((len(starts), k))
    return sums / np.maximum(size, 1)[:, None]


def predictor(model: dict):
    names, k = model["names"], len(model["names"])

    def predict(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its probability) of each text. Log likelihoods are summed over words and
        tempered by the root of their number, as neighbouring words are no independent witnesses."""
        total, n = np.zeros((len(texts), k)), np.zeros(len(texts))
        for b, owner in blocks(texts, lower=True):
            if not len(b.starts):
                continue
            words, first, back = np.unique(b.words(), return_index=True, return_inverse=True)
            row = _find(model["words"], words)
            scores = np.empty((len(words), k))
            scores[row >= 0] = model["words"][1][row[row >= 0]]
            new = np.flatnonzero(row < 0)
            scores[new] = _unseen(model, b, b.starts[first[new]], b.ends[first[new]], k)
            text = np.repeat(owner, b.counts)
            for c in range(k):
                total[:, c] += np.bincount(text, scores[back, c], len(texts))
            n += np.bincount(text, minlength=len(texts))
        total /= np.sqrt(np.maximum(n, 1))[:, None]
        z = total - total.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]

    return names, predict


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, all_rows: int = ALL_ROWS, all_bytes: int = ALL_BYTES) -> dict:
    """Count on at most `rows` rows of each language of labelled (key, text, lang), in one task; the model is a few MB.

    They are the rows with the smallest hashed keys. A language's hashes below rows / its number of keys (and a tenth
    for chance) are cut off first, so no task sorts a whole language. All languages are learnt: where there are many, each
    gives its part of all_rows and all_bytes, and one text at least, whole. A key with several texts in a language gives
    its smallest; rows with a null key, text or lang teach nothing; an empty table gives a model without languages."""
    fine = labelled.filter("key is not null and lang is not null and text is not null")
    unit = (F.shiftrightunsigned(F.xxhash64("key"), 11)).cast("double") / float(1 << 53)
    langs = materialize(fine.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("keys")), "languages")
    n = max(1, langs.count())
    rows, most = max(1, min(rows, all_rows // n)), all_bytes // n
    shares = langs.select("lang", (F.lit(1.1 * rows + 100) / F.col("keys")).alias("share"))
    shares = F.broadcast(shares) if n <= BROADCAST_LANGUAGES else shares
    low = fine.join(shares, "lang").filter(unit <= F.col("share")).groupBy("key", "lang").agg(F.min(F.octet_length("text")).alias("size"))
    least = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    before = F.coalesce(F.sum("size").over(least.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = low.withColumns({"k": F.row_number().over(least), "before": before}).filter((F.col("k") <= rows) & (F.col("before") <= most)).select("key", "lang")
    sample = fine.join(F.broadcast(ids), ["key", "lang"], "leftsemi").groupBy("key", "lang").agg(F.min("text").alias("text"))

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        table = pa.concat_tables(tables).sort_by([("key", "ascending"), ("lang", "ascending")]) if tables else None
        model = train(table.column("text").to_pylist(), table.column("lang").to_pylist()) if table else train([], [])
        yield pa.RecordBatch.from_pylist([{"model": pickle.dumps(model)}], schema=pa.schema([("model", pa.binary())]))

    got = sample.select("key", F.lower("text").cast("binary").alias("text"), "lang").repartition(1).mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(got["model"]) if got else train([], [])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score. A null text or one without a letter is `und` with score 1; so is every text when
    nothing was learnt. Columns of these names are replaced; other columns and repeated rows stay."""
    short_batches(docs.sparkSession)
    names, predict = predictor(model)
    has_letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    if not names:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(1.0)})

    def run(batches):
        for texts in batches:
            best, p = predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": np.array(names, object)[best], "score": p})

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    got = "_got"
    while got in docs.columns:
        got += "_"
    docs = docs.drop("lang_pred", "score").withColumn(got, of(F.lower("text").cast("binary")))
    return docs.withColumns({
        "lang_pred": F.when(has_letter, F.col(f"{got}.lang_pred")).otherwise("und"),
        "score": F.when(has_letter, F.col(f"{got}.score")).otherwise(1.0),
    }).drop(got)
