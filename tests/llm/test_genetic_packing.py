import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from decisa.llm import genetic_packing as gp

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def is_packing(bin_of, sizes, length):
    return len(bin_of) == len(sizes) and (bin_of >= 0).all() and np.bincount(bin_of, weights=sizes).max() <= length


def exact(sizes, length):
    """The fewest bins, by trying everything."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                go(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, length - sizes[k]])

    go(0, [])
    return best[0]


def test_bound_is_below_the_fewest_bins():
    rng = np.random.default_rng(1)
    for _ in range(150):
        sizes = np.sort(rng.integers(1, 20, rng.integers(1, 9)))[::-1]
        least = gp.fewest(sizes, 20)
        assert -(-int(sizes.sum()) // 20) <= least <= exact(sizes.tolist(), 20)


def test_best_fit_takes_the_fullest_bin():
    sizes = np.array([6, 5, 4, 5])
    assert gp.best_fit(sizes, 10, np.arange(4), np.empty(4, int), []).tolist() == [0, 1, 0, 1]


def test_evolution_beats_its_founders():
    rng = np.random.default_rng(4)
    base = rng.integers(20, 80, (60, 3))  # triples that fill a bin exactly
    sizes = np.concatenate([base, 200 - base.sum(1, keepdims=True)], axis=1)
    sizes = sizes[(sizes > 0).all(1)].ravel()
    least = gp.fewest(sizes, 200)
    first = gp.founders(sizes, 200, 6, np.random.default_rng(5), True)
    last = gp.evolve(first, sizes, 200, 300, least, np.random.default_rng(6), 6)
    assert all(is_packing(p, sizes, 200) for p in [*first, *last])
    before, after = (max(gp.fitness(p, sizes, 200) for p in x) for x in (first, last))
    assert after > before and -after[0] >= least


def test_crossover_keeps_injected_bins_whole():
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 60, 200)
    mine, other = gp.founders(sizes, 100, 2, rng, False)
    child = gp.crossover(mine, other, sizes, 100, rng)
    assert is_packing(child, sizes, 100)
    groups = lambda p: {frozenset(np.flatnonzero(p == b).tolist()) for b in np.unique(p)}
    assert len(groups(child) & groups(other)) >= 3


def packing(spark, lengths, **settings):
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "piece_key long, length long").repartition(3)
    return sorted(map(tuple, gp.pack(rows, 100, **settings).collect()))


def test_pack_over_blocks_and_islands(spark):
    rng = np.random.default_rng(8)
    lengths = np.concatenate([rng.integers(26, 55, 700), [100, 100, 1, 99]])
    settings = {"block": 150, "islands": 3, "population": 3, "epochs": 2, "crossovers": 4}
    out = packing(spark, lengths, **settings)
    assert [k for k, _, _ in out] == list(range(len(lengths)))
    by_bin = {}
    for k, s, offset in out:
        by_bin.setdefault(s, []).append((offset, int(lengths[k])))
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    plain = len(np.unique(gp.founders(lengths, 100, 1, rng, True)[0]))
    assert len(by_bin) <= plain + 4
    assert packing(spark, lengths, **settings) == out


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    texts = ["Some words here", None, "", "a b " * 40, "x", "same", "same", "<|endoftext|>", "y " * 63, "z " * 31, "é́ 　 Ａ"]
    rows = [(None if k == 4 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, piece int")
    out = gp.packed(docs, WORDS, length=32).collect()
    want = []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(key, k // 32, k, len(ids[k : k + 32]), zlib.crc32(ids[k : k + 32].tobytes()), ids[k : k + 32].tobytes()) for k in range(0, len(ids), 32)]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = {}
    for r in out:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], bytes(r["ids"])))
    joined = {s: b"".join(ids for _, ids in sorted(parts)) for s, parts in whole.items()}
    assert max(map(len, joined.values())) <= 4 * 32
    seen = gp.sequences(spark.createDataFrame([tuple(r) for r in out], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in seen} == joined
    assert {r["sequence_id"]: 4 * r["length"] for r in seen} == {s: len(x) for s, x in joined.items()}


def test_empty_table(spark):
    assert gp.packed(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []
    assert gp.pack(spark.range(0).select(F.col("id").alias("piece_key"), F.col("id").alias("length"))).collect() == []
