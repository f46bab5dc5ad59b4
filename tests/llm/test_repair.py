import os
import random
import zlib

import numpy as np
import pytest

from decisa.llm import repair

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n", "a  b", "a\n b", " a", "a ", "a \nb", "<|endoftext|> x", "it's don't's\n'll", "a\u00a0b c", "a\x1cb c", "\u00e9\u4e2d\U0001f600 x\ny", "x, y. z!", "Hello world,\nhello world.", "tab\tx", "a,b c1d 22", "... !!! a!!", "\u2028 a"]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_tokenizers_ids():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("ab ,.!*_\n\t\u00e9\u2014'1", k=rng.randrange(30))) for _ in range(900)]
    encode = repair.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == whole(texts)


def test_words_of_letters_skip_the_splitting_pattern(monkeypatch):
    rng, others = random.Random(4), []
    encode = repair.Encoder(PATH)
    learn = encode._learn_others
    monkeypatch.setattr(encode, "_learn_others", lambda b, starts, *rest: (others.append(len(starts)), learn(b, starts, *rest)))
    words = ["".join(rng.choices("abcdefgXYZ\u00e9\u00df\u00ff\u00c0", k=rng.randrange(1, 12))) for _ in range(3000)]
    texts = ["\n".join(" ".join(words[k : k + 7]) for k in range(a, a + 100, 7)) for a in range(0, 2900, 100)]
    assert [x.tolist() for x in encode([t.encode() for t in texts])] == whole(texts)
    assert encode.by_words and sum(others) == 0
    texts = ["".join(rng.choices("a\u00e9\u00df\u00d7\u00f7\u0100\u0130\u0301\u4e2d ,.'s\n1", k=rng.randrange(30))) for _ in range(900)]
    assert [x.tolist() for x in encode([t.encode() for t in texts])] == whole(texts)
    assert sum(others) > 0


@pytest.mark.parametrize(("cache", "recent"), [(5, 3), (40, 10), (1000, 7)])
def test_small_cache(monkeypatch, cache, recent):
    monkeypatch.setattr(repair, "CACHE", cache)
    monkeypatch.setattr(repair, "RECENT", recent)
    rng = random.Random(2)
    encode, words = repair.Encoder(PATH), [f"w{k}" if k % 3 else "ab" + "cd" * k for k in range(60)]
    for k in range(60):
        texts = [*TEXTS[k % 19 : k % 19 + 2], " ".join(rng.choice(words) + rng.choice(["", ".", "!!", "\n" + rng.choice(words)]) for _ in range(30))]
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == whole(texts)


def test_long_texts_over_blocks(monkeypatch):
    from decisa.llm import words

    monkeypatch.setattr(repair, "blocks", lambda texts, lower: words.blocks(texts, lower, 64))
    rng = random.Random(3)
    texts = [rng.choice([" ", "\n", " ", "  "] if k % 5 == 0 else [" ", "\n"]).join(rng.choices(["one", "two,", "\u00e9t\u00e9", "4th"], k=200)) for k in range(20)]
    texts += ["x" * 500, "a " * 100, "\n".join(["line"] * 90), "", "y"]
    assert [x.tolist() for x in repair.Encoder(PATH)([t.encode() for t in texts])] == whole(texts)


def test_grammar_round_trip(monkeypatch):
    monkeypatch.setattr(repair, "LEAST", 3)
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 60)
    ids = rng.zipf(1.5, int(sizes.sum())).astype(np.uint32) % 5000
    symbols, of_doc, rules, lengths = repair.compress(ids, np.cumsum(sizes), 5000)
    assert len(symbols) < len(ids) and of_doc.sum() == len(symbols)
    assert np.array_equal(repair.expand(symbols, rules, lengths, 5000), ids)
    texts = [ids[e - n : e - 1] for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    shard = repair._shard(0, 0, list(range(60)), texts)
    for k in (0, 17, 59):
        assert repair.decode_document(shard, k).tolist() == [*texts[k].tolist(), 0]


def test_rounds_count_only_what_can_have_changed(monkeypatch):
    rng, looked, bucket = np.random.default_rng(5), [], repair._bucket
    phrases = [rng.integers(0, 3000, n) for n in (2, 3, 5, 9, 17, 33, 65)]
    ids = np.concatenate([x for _ in range(3000) for x in (phrases[rng.integers(0, 7)], rng.integers(0, 40_000, 60))]).astype(np.uint32)
    monkeypatch.setattr(repair, "_bucket", lambda a, b: (looked.append(len(a)), bucket(a, b))[1])
    symbols, of_doc, rules, lengths = repair.compress(ids, np.array([len(ids) // 3, len(ids)]), 40_000)
    assert np.array_equal(repair.expand(symbols, rules, lengths, 40_000), ids) and of_doc.sum() == len(symbols)
    assert max(pair_counts(symbols, of_doc.astype(int)).values()) < repair.LEAST
    assert lengths.max() >= 65 and sum(looked) < 3 * len(ids)


@pytest.mark.parametrize("width", [1, 7, 8, 16, 17, 31])
def test_packed_symbols(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 1003).astype(np.uint32)
    data = repair.pack(x, width)
    assert len(data) == -(-1003 * width // 8)
    for a, b in ((0, 1003), (0, 0), (5, 6), (17, 900), (1002, 1003)):
        assert np.array_equal(repair.unpack(data, width, a, b), x[a:b])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_shards_are_smaller_than_plain_ids():
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    shard = repair._shard(0, 0, list(range(len(texts))), repair.Encoder(PATH)(texts))
    size = sum(len(x) for x in shard.values() if isinstance(x, bytes))
    assert size < 0.7 * 2 * shard["tokens"]


def pair_counts(symbols, of_doc):
    """Occurrences of each pair without overlaps, from left to right, none over a document's end."""
    counts = {}
    for doc in np.split(symbols, np.cumsum(of_doc)[:-1]):
        last = {}
        for i, pair in enumerate(zip(doc.tolist(), doc[1:].tolist(), strict=False)):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                counts[pair] = counts.get(pair, 0) + 1
                last[pair] = i
    return counts


PASSAGE = np.random.default_rng(3).integers(0, 50_000, 700)


@pytest.mark.parametrize(("doc", "copies", "most"), [([7] * 4095, 3, 200), ([7, 9] * 3000, 3, 200), ([*[7] * 5, 8] * 500, 2, 200), (PASSAGE, 90, 200), ([*PASSAGE, *[7] * 33], 90, 300)])
def test_no_frequent_pair_is_left(doc, copies, most):
    texts = [np.array(doc, np.uint32)] * copies + [np.zeros(0, np.uint32), np.array([7, 7, 7], np.uint32)]
    shard = repair._shard(0, 0, list(range(len(texts))), texts)
    of_doc = np.frombuffer(shard["doc_symbols"], "<u4")
    symbols = repair.unpack(shard["symbols"], shard["width"], 0, int(of_doc.sum()))
    assert max(pair_counts(symbols, of_doc.astype(int)).values()) < repair.LEAST and len(symbols) < most + 2 * copies
    assert np.frombuffer(shard["lengths"], "<u4").max() > 16
    for k, t in enumerate(texts):
        assert repair.decode_document(shard, k).tolist() == [*t.tolist(), 0]


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_files(spark, monkeypatch, shard):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "none"), (300, "again"), (300, "again"), (200, "word " * 3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(4)
    path = repair.fresh_path(spark, "t")
    repair.write_tokens(df, PATH, path, shard)
    got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in repair.read_tokens(spark.read.parquet(path)).collect())
    at, want = 0, []
    for i, t in sorted(((-1 if i is None else i, t or "") for i, t in rows)):
        ids = np.array([*whole([t])[0], 0], "<u4")
        want.append((at, len(ids), i, zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_empty(spark):
    assert repair.encode_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
