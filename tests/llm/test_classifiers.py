import math
import random
import re
import zlib

import numpy as np
import pytest

from decisa.llm import language_id, quality
from decisa.llm import words
from decisa.llm.words import U64, Block, blocks

VOICES = {"en": "th he in er an re on at", "fr": "eau oi que ai ou el ent", "de": "sch ein ung ich keit \u00fc"}


def word(rng, lang):
    return "".join(rng.choice(VOICES[lang].split()) for _ in range(rng.randrange(1, 4)))


def text(rng, lang, junk=False):
    w = [word(rng, lang) for _ in range(rng.randrange(5, 60))]
    if junk:
        kind = rng.randrange(3)
        w = [x.upper() + "!!" for x in w] if kind == 0 else [x + rng.choice(["***", "$$$", "%%%"]) for x in w] if kind == 1 else [w[i // 8] for i in range(len(w))]
    return " ".join(w)


def rows(n=700):
    rng = random.Random(3)
    return [(i, lang, int(not junk), text(rng, lang, junk)) for i in range(n) for lang in [rng.choice(list(VOICES))] for junk in [rng.random() < 0.25]]


def test_quality_on_held_out_rows(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "s") for i, _, _, t in data] + [(9000, None, "s"), (9001, "", "s"), (9002, "x " * 300_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in data] + [(None, 1), (9100, None)], "doc_id long, quality int")
    model = quality.fit(docs.selectExpr("doc_id as key", "text"), quality.learnable(labels))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    held = [(i, q) for i, _, q, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert np.mean([(got[i] >= quality.KEEP) == (q == 1) for i, q in held]) > 0.93
    assert all(0 <= got[i] <= 1 for i in (9000, 9001, 9002))
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (9000, 9001)").count() == 2
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "key long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "key long, label int"))
    assert quality.score_quality(docs, model).first()["score"] > 0.9


def test_a_text_scores_the_same_between_any_neighbours():
    model = quality.train([t.encode() for _, _, _, t in rows(200)], np.array([q for _, _, q, _ in rows(200)]))
    score = quality.scorer(model)
    texts = [b"", None, b"a", b"a b", b"b a", b" b\n", b"spam spam", b"x " * 300_000, b"he", *[t.encode() for _, _, _, t in rows(60)]]
    alone = [score([t])[0] for t in texts]
    rng = random.Random(5)
    for _ in range(5):
        order = rng.choices(range(len(texts)), k=100)
        assert score([texts[i] for i in order]).tolist() == [alone[i] for i in order]


def test_training_keeps_texts_apart():
    bags = lambda texts: [sorted(f[owner == i].tolist()) for f, owner in quality._by_text(texts) for i in range(len(texts))]
    assert bags([b"a b", b"b a c", b"c"]) == bags([b"a b"]) + bags([b"b a c"]) + bags([b"c"])


@pytest.mark.parametrize("empty", [False, True])
def test_language(spark, empty):
    data = [] if empty else rows(500)
    learn = [(i, t, x) for i, x, _, t in data if zlib.crc32(str(i).encode()) % 3 != 1] + [(None, "zz", "xx"), (7000, None, "en"), (7001, "q", None)]
    model = language_id.fit(spark.createDataFrame(learn, "key long, text string, lang string"))
    docs = spark.createDataFrame([(i, t, "k") for i, _, _, t in data] + [(9000, None, "k"), (9001, "123 !?", "k"), (9002, "", "k"), (9003, "\u4e2d\u6587", "k")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert got[9000] == got[9001] == got[9002] == ("und", 1.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    if empty:
        assert {x for x, _ in got.values()} == {"und"}
    else:
        held = [(i, x) for i, x, _, _ in data if zlib.crc32(str(i).encode()) % 3 == 1]
        assert np.mean([got[i][0] == x for i, x in held]) > 0.97
        assert got[9003][0] in VOICES


def test_unseen_words_use_shorter_grams():
    texts = [b"aaab aaac aaad", b"zzzy zzzx zzzw"] * 5
    names, predict = language_id.predictor(language_id.train(texts, ["a", "z"] * 5))
    best, p = predict([b"aaaq", b"zzzzzzzq", b"", b"qqqq"])
    assert [names[b] for b in best[:2]] == ["a", "z"] and (p[:2] > 0.5).all() and p[2] == 0.5


def test_grams_count_for_every_language_of_a_word_in_any_order(monkeypatch):
    texts, langs = [b"shared apple", b"shared zebra", b"shared shared yak"], ["a", "z", "z"]
    model = language_id.train(texts, langs)
    for order in ([0, 1, 2], [2, 1, 0]):
        for block in (1 << 20, 8):
            monkeypatch.setattr(language_id, "blocks", lambda t, lower, block=block: blocks(t, lower, block))
            again = language_id.train([texts[i] for i in order], [langs[i] for i in order])
            for n in map(str, language_id.ORDERS):
                assert all(np.array_equal(x, y) for x, y in zip(model[n], again[n], strict=True))
    b = Block([b"shared"], True)
    at = np.arange(2)
    whole = language_id._find(model["5"], b.hashes(at, at + 5) + U64(5))
    counts = np.exp(model["5"][1][whole])
    assert (whole >= 0).all() and (counts.min(axis=1) > 2 * np.exp(model["5"][1].min(axis=0)).max()).all()


MASK = (1 << 64) - 1
SPACES = r"[\x20\x09-\x0D]+"


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_hash(data, lower=False):
    """The hash of some bytes, a byte at a time."""
    table = words._lowered if lower else words._codes
    return plain_mix((sum(int(table[c]) * pow(words._BASE, i, 1 << 64) for i, c in enumerate(data)) + len(data)) & MASK)


EDGE_TEXTS = ["", " ", "a", "\u4e2d\u6587\u6587\u4e2d\u6587", "\u00c9T\u00c9 \u00e9t\u00e9", "x" * 200, "he he he he", "spam! spam! spam!", "\t\n he \r\n th\x0b"]


def test_quality_equals_plain_rescoring():
    model = quality.train([t.encode() for _, _, _, t in rows(200)], np.array([q for _, _, q, _ in rows(200)]))
    texts = EDGE_TEXTS + [t for _, _, _, t in rows(30)]
    for text_, got in zip(texts, quality.scorer(model)([t.encode() for t in texts]), strict=True):
        w = [x for x in re.split(SPACES, text_) if x]
        h = [plain_hash(x.encode()) for x in w]
        found = [x + 1 for x in h] + [a * 0x9E3779B97F4A7C15 + b + 2 for a, b in zip(h, h[1:])]
        found += [plain_hash(x.encode()[i : i + n]) + 3 for x in w for n in quality.GRAMS for i in range(len(x.encode()) - n + 1)]
        found += [k for k in range(1, quality.REPEATS + 1) for a, b in zip(h, h[k:]) if a == b]
        bags = [plain_mix(f & MASK) & (quality.BUCKETS - 1) for f in found]
        mean = sum((model["vectors"][f].astype(float) for f in bags), np.zeros(quality.DIM)) / max(1, len(bags))
        z = mean @ model["layer"].astype(float) + model["bias"].astype(float)
        assert got == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-6)


def test_language_equals_plain_rescoring(spark):
    learn = [(i, t, x) for i, x, _, t in rows(200)] + [(900 + i, "\u4e2d\u6587 \u6587\u5b57 \u00c9t\u00e9 " * 3, "zh") for i in range(5)]
    model = language_id.fit(spark.createDataFrame(learn, "key long, text string, lang string"))
    tables = {n: dict(zip(model[n][0].tolist(), model[n][1].astype(float), strict=True)) for n in ("words", *map(str, language_id.ORDERS))}
    texts = EDGE_TEXTS + ["\u4e2d\u6587\u6587\u5b57\u5b57", "unseen qqq", "\u00c9T\u00c9"] + [t for _, _, _, t in rows(30)]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        ws, total = [x for x in re.split(SPACES, texts[r["doc_id"]].lower()) if x], np.zeros(len(model["names"]))
        for w in ws:
            if (row := tables["words"].get(plain_hash(w.encode()))) is not None:
                total += row
                continue
            for i in range(len(w)):
                for depth, n in enumerate(language_id.ORDERS):
                    row = tables[str(n)].get((plain_hash(w[i : i + n].encode()) + n) & MASK) if i + n <= len(w) else None
                    if row is not None:
                        total += (row + depth * math.log(language_id.BACKOFF)) / len(w)
                        break
        total /= math.sqrt(max(1, len(ws)))
        p = np.exp(total - total.max())
        if any(c.isalpha() for c in texts[r["doc_id"]]):
            assert r["lang_pred"] == model["names"][int(p.argmax())] and r["score"] == pytest.approx(p.max() / p.sum(), abs=1e-4)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 1.0)


def test_repeated_keys_teach_the_same_in_any_order(spark):
    data = [(i % 40, t, x) for i, x, _, t in rows(160)]
    models = [language_id.fit(spark.createDataFrame(random.Random(s).sample(data, len(data)), "key long, text string, lang string").repartition(s), rows=9) for s in (2, 5)]
    assert all(np.array_equal(a, b) for n in ("words", "5", "1") for a, b in zip(models[0][n], models[1][n], strict=True))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "key long, label int")
    scored = [quality.fit(spark.createDataFrame(random.Random(s).sample(data, len(data)), "key long, text string, lang string").repartition(s), labels) for s in (2, 5)]
    assert all(np.array_equal(scored[0][n], scored[1][n]) for n in scored[0])


def test_all_languages_are_learnt_within_the_bounds(spark):
    rows = [(k, f"word{k % 230} other{k % 230} " * 3, f"l{k % 230:03d}") for k in range(460)] + [(1000, "longest " * 5000, "one"), (1001, "remaining " * 5000, "one")]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    model = language_id.fit(docs, all_rows=462, all_bytes=231 * 300)
    assert len(model["names"]) == 231  # one of the long texts is learnt whole, the other one is beyond the bytes
    asked = spark.createDataFrame([(k, f"word{k} other{k}", "kept", 1) for k in range(230)], "doc_id long, text string, _got string, _got_ int")
    out = language_id.identify(asked, model)
    assert out.columns == ["doc_id", "text", "_got", "_got_", "lang_pred", "score"]
    got = out.collect()
    assert all(r["lang_pred"] == f"l{r['doc_id']:03d}" and r["_got"] == "kept" for r in got)
