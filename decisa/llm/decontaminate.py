"""Benchmark decontamination by spaced-seed hashing, in column expressions and joins only.

A mask is laid over every position of a text; the words under its 1s are hashed together, those under its 0s may
differ. Test items and training texts meet on equal hashes; each hit fixes an alignment, and the words aligned around
it are compared: a text is contaminated when some stretch of WINDOW aligned words (the whole item, if shorter) agrees
in at least AGREE of them. The masks miss no such stretch. Items of less than six words are found word for word only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisa.session import materialize

#: Fixed masks of six words each; between them they leave out single words and pairs at most places of a stretch.
MASKS = ("111111", "1110111", "11011011", "110100111")
#: Further masks for items of some lengths, for the substitutions that MASKS leave out there: with them, every stretch of
#: 6 to WINDOW words that agrees in AGREE of its words has a seed. Texts are seeded with those of the lengths there are.
SHORT = {6: ("1111", "11011"), 7: ("11111", "1101011"), 10: ("101001011",), 11: ("11111",), 15: ("11111",)}
#: Items of fewer words have one mask, all their words.
LEAST = 6
#: Words of a piece that seeds are taken from at once.
PIECE = 2048
WINDOW = 20
AGREE = 0.8
#: Rows (16 to 24 bytes) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def with_codes(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the hashes of the text's lower-cased words, runs of bytes outside 0x20 and 0x09-0x0D; none for null."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+", -1)
    return df.withColumn(out, F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w)))


def seeds(table: DataFrame, codes: str, *keep: str, short: Iterable[int] = (), own: bool = False) -> DataFrame:
    """keep, seed and place (from 0) for every mask and position of non-empty sequences. The further masks are those for
    items of `short` words; with `own`, only sequences of that length have them. Sequences are cut into pieces of PIECE
    words that overlap by a mask first, so a very long text costs no more memory than its words."""
    span = max(map(len, MASKS))
    of_length: dict[str, list[int]] = {}
    for n in sorted(set(short)):
        for m in further_masks(n):
            of_length.setdefault(m, []).append(n)
    sized = [F.size(codes).alias("n")] if own else []
    starts = lambda c: F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)), F.lit(PIECE))
    cut_up = lambda c: F.transform(starts(c), lambda at: F.struct(at.alias("base"), F.slice(c, at + 1, F.lit(PIECE + span - 1)).alias("part")))
    # as a lambda's argument, the sequence is computed once however often it is used
    cut = table.select(*keep, *sized, F.inline(F.flatten(F.transform(F.array(codes), cut_up))))
    shifted = cut.select(*keep, *[F.col("n") for _ in sized], "base", F.inline(F.arrays_zip(*[F.slice("part", F.lit(k + 1), F.greatest(F.size("part") - k, F.lit(0))) for k in range(span)], F.sequence(F.lit(0), F.size("part") - 1))))
    shifted = shifted.toDF(*keep, *["n" for _ in sized], "base", *[f"w{k}" for k in range(span)], "at").filter(F.col("w0").isNotNull() & (F.col("at") < PIECE))
    masks = [(m, F.xxhash64(F.lit(i), *_under(m)), F.lit(True)) for i, m in enumerate(MASKS)]
    masks += [(m, F.xxhash64(F.lit(m), *_under(m)), F.col("n").isin(n) if own else F.lit(True)) for m, n in of_length.items()]
    each = [F.when(F.col(f"w{len(m) - 1}").isNotNull() & applies, seed) for m, seed, applies in masks]
    return shifted.select(*keep, (F.col("base") + F.col("at")).alias("place"), F.explode(F.array(*each)).alias("seed")).filter("seed is not null")


def further_masks(n: int) -> tuple[str, ...]:
    """The masks that items of n words have beside MASKS; all their words, where they are fewer than a mask has."""
    return ("1" * n,) if n < LEAST else SHORT.get(n, ())


def _under(mask: str) -> list[Column]:
    return [F.col(f"w{k}") for k, bit in enumerate(mask) if bit == "1"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """(key, items, best): the md5 of each contaminated text, the sorted ids of its items, the best share of agreeing words.

    docs needs text, benchmark item_id and text. Null and empty texts on either side match nothing. Items of one id
    are separate items; a null item_id is kept in items as -1.
    """
    items = with_codes(benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text"), "text", "item")
    items = materialize(items.select("item_id", "item").filter(F.size("item") > 0).distinct(), "items")
    short = [r["n"] for r in items.select(F.size("item").alias("n")).filter(F.col("n").isin(*range(1, LEAST), *SHORT)).distinct().collect()]  # of ten lengths
    item_seeds = seeds(items, "item", "item_id", "item", short=short, own=True).select("seed", "item_id", F.xxhash64("item").alias("item_hash"), F.col("place").alias("item_place"))
    item_seeds = materialize(item_seeds, "item-seeds")
    item_seeds = _small(item_seeds, item_seeds.count())

    texts = with_codes(docs.select(F.md5(F.col("text").cast("binary")).alias("key"), "text"), "text", "codes")
    hits = seeds(texts, "codes", "key", short=short).join(item_seeds, "seed")
    hits = hits.select("key", "item_id", "item_hash", (F.col("place") - F.col("item_place")).alias("shift"))
    hits = materialize(hits.distinct(), "hits")

    n = hits.select("key").distinct().count()
    found = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), "text").join(_small(hits.select("key").distinct(), n), "key", "leftsemi")
    found = with_codes(found.dropDuplicates(["key"]), "text", "codes").select("key", "codes")
    pairs = hits.join(found, "key").join(items.withColumn("item_hash", F.xxhash64("item")), ["item_id", "item_hash"])
    place = lambda k: k + F.col("shift")
    same = F.transform("item", lambda w, k: F.when((place(k) >= 0) & (place(k) < F.size("codes")), F.coalesce(F.get("codes", place(k)) == w, F.lit(False)).cast("int")).otherwise(0))
    wide = F.least(F.lit(window), F.size("item"))
    stretches = F.transform(F.sequence(F.lit(1), F.size("item") - wide + 1), lambda s: F.aggregate(F.slice("same", s, wide), F.lit(0), lambda a, x: a + x))
    pairs = pairs.withColumn("same", same).withColumn("best", F.array_max(stretches) / wide)
    pairs = pairs.filter((F.col("best") >= agree) & ((F.size("item") >= LEAST) | (F.col("best") == 1.0)))
    return pairs.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("best").alias("best"))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """(doc_id, contaminated, items, best) for every row of docs; clean rows have no items and best 0."""
    bad = materialize(contaminated_texts(docs, benchmark, window, agree), "contaminated")
    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    out = rows.join(_small(bad, bad.count()), "key", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """The rows of docs whose texts are not contaminated, with all their columns; null texts stay."""
    bad = materialize(contaminated_texts(docs, benchmark, window, agree).select("key"), "contaminated")
    bad = _small(bad, bad.count())
    return docs.join(bad, F.md5(docs["text"].cast("binary")) == bad["key"], "leftanti")
