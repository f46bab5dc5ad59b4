import random
import re

import numpy as np
import pytest

from decisa.llm import jaccard_join as J
from decisa.llm.signature_tree import SignatureTree, bitmap_bits, dual_traversal, linked
from decisa.llm.words import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """[(doc_id, n, component_id)] of rows (doc_id, text), by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)], key=str)


def fixture(seed=1, groups=6, size=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows, at = [], 0
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([40, 120, 300]))
        for k in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if k % 5 == 0:
                w += passage
            rows.append((at, " ".join(w).upper() if k == 3 else "\n".join(w)))
            at += 1
    for _ in range(20):
        rows.append((at, " ".join(rng.choices(vocabulary, k=30) + passage)))
        at += 1
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b c"), (906, "a  b c"), (907, "a b c d e"), (None, "a b c d e"), (905, "a b c"), (None, None), (908, "x" * 5000), (909, "e\u00e9 \u00c9 \u4e2d\u6587 b c d e"), (910, "E\u00e9 \u00c9 \u4e2d\u6587 B C D E")]


@pytest.mark.parametrize("chunk", [512, 4])
def test_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(J, "HOT_ROWS", 1)
    monkeypatch.setattr(J, "HOT_CLASSES", 3)
    rows = fixture() + EDGES
    df = spark.createDataFrame([(d, t, 7, "n", 1) for d, t in rows], "doc_id long, text string, n int, fp string, component_id int").repartition(5)
    got = J.jaccard_components(df, chunk=chunk)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert sorted([tuple(r)[:3] for r in got.collect()], key=str) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).collect() == []
    assert J.first_of_components(df).collect() == []


def test_one_of_each_component_stays(spark):
    rows = fixture(2, 4, 8) + [(5, "a b c d e f"), (5, "a b c d e f"), (None, None), (None, ""), (None, None)]
    df = spark.createDataFrame([(d, t, i, str(i), -i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _id int, key string, _key int")
    kept = J.first_of_components(df)
    assert kept.dtypes == df.dtypes
    assert all(r["_id"] == -r["_key"] == int(r["key"]) and rows[r["_id"]] == (r["doc_id"], r["text"]) for r in kept.collect())
    got = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"] and r["doc_id"] != 5)
    want = sorted((d, next(t for e, t in rows if e == d)) for d, n, c in set(brute(rows)) if n and d == c and d != 5)
    assert got == want
    assert kept.filter("text is null or text = ''").count() == 3
    assert kept.filter("text = 'a b c d e f'").count() == 1


def test_dual_traversal_loses_no_link():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for _ in range(40):
        base = rng.choice(pool, rng.integers(5, 200), replace=False)
        for _ in range(4):
            keep = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, 3)])))
    for left, right in ((sets, None), (sets[:37], sets[37:])):
        bits = bitmap_bits([len(s) for s in sets])
        x, y = SignatureTree(left, bits), SignatureTree(right, bits) if right else None
        found = {(min(a, b), max(a, b)) if right is None else (a, b) for i, j in dual_traversal(x, y, 4, 5) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        other = right or left
        want = {(i, j) for i in range(len(left)) for j in range(len(other)) if (right is not None or i < j) and linked(left[i], other[j], 4, 5)}
        assert want <= found
        assert len(found) < len(left) * len(other) / 4


def test_words_over_blocks(monkeypatch):
    from decisa.llm import words

    texts = [b"", None, b"  a b\tc ", ("word " * 4000).encode(), b"x" * 9000, "\u00e9t\u00e9 d".encode()]
    whole, counts = word_hashes(texts)
    assert counts.tolist() == [0, 0, 3, 4000, 1, 2]
    hashes = word_hashes([b"word"])[0]
    assert (whole[3:4003] == hashes[0]).all()
    assert [len(s) for s in shingle_sets(texts)] == [0, 0, 1, 1, 1, 1]
    pieces = list(words.segments(b"ab cd ef gh", 4))
    assert b"".join(pieces) == b"ab cd ef gh" and len(pieces) > 1
