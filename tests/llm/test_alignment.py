import hashlib
from collections import Counter

import numpy as np
import pytest

from decisa.llm import alignment
from decisa.llm.encoders import PieceEncoder, SpacedEncoder, WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n):
    import random

    rng = random.Random(11)
    alphabet = ["a", " ", "\n", "'s", ".", ",", "é", "Ａ", "日", "é", "7", "_", "  ", "<", "▁", "T", "he", "'", " ", " ", "Σ"]
    fixed = ["", " ", "  a b", "a\n\nb", "\n", "a \n b", "x\tb", "<s> <0x0A> <unk> <|endoftext|> <|startoftext|>", "a▁b ▁ ▁", "\x00 b", "a,b.c d=e̸", "= ̸a", "ΑΣ. ΑΣ a", "a\r\nb", "I'LL x'", "...", "word... ?! (a) [b]", "a\x85b", "😀 👩‍👩 c"]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(n)]


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, w = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    a.encode_special_tokens = w.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = lambda t: lambda text: t.encode(text, add_special_tokens=False).ids
    return lambda text: ids(a)(" " + text), m.encode, ids(w)


def test_encoders_give_the_libraries_ids():
    texts = random_texts(3000)
    for encoder, plain in zip((SpacedEncoder(BYTES), PieceEncoder(PIECES), WordEncoder(WORDS)), libraries(), strict=True):
        assert encoder.splits
        for _ in range(2):
            assert [x.tolist() for x in encoder([t.encode() for t in texts])] == [list(plain(t)) for t in texts]


def brute_force(rows):
    spaced, piece, _ = libraries()
    names = SpacedEncoder(BYTES).token_bytes(), PieceEncoder(PIECES).token_bytes()
    per, count = [], Counter()
    for key, text in rows:
        sides = [f(text) if text else [] for f in (spaced, piece)]
        if any(b"".join(n[i] for i in ids) != (" " + (text or "")).encode() for n, ids in zip(names, sides, strict=True)):
            sides = [[], []]
        ranges = []
        for n, ids in zip(names, sides, strict=True):
            at = np.cumsum([0, *[len(n[i]) for i in ids]]).tolist()
            ranges.append(list(zip(ids, at, at[1:], strict=False)))
        links = [(i, j) for i, a, b in ranges[0] for j, c, d in ranges[1] if a < d and c < b]
        count.update(links)
        begin, out = 0, []
        for end in sorted({b for _, _, b in ranges[0]} & {d for _, _, d in ranges[1]}):
            out.append("|".join(",".join(str(i) for i, a, _ in side if begin <= a < end) for side in ranges))
            begin = end
        per.append((key, len(sides[0]), len(sides[1]), len(out), links, hashlib.sha256(";".join(out).encode()).hexdigest() if out else ""))
    best = {}
    for (_, j), c in count.items():
        best[j] = max(best.get(j, 0), c)
    return sorted(((k, a, b, g, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), h) for k, a, b, g, x, h in per), key=str)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 1])
def test_against_all_pairs(spark, frequent):
    rows = [(k % 90, t) for k, t in enumerate(random_texts(80))] + [(None, "the same text"), (None, "the same text"), (5, None), (6, "one two\nthree, four " * 20)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, links int").repartition(3)
    got = alignment.align(docs, BYTES, PIECES, frequent=frequent).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)


def test_slices_of_a_long_text(monkeypatch):
    texts = [("some words, and 日本語 more\nof them " * 300).encode(), b"short", ("x" * 5000 + " y").encode(), b""]
    sides = alignment._sides((BYTES, PIECES))
    whole = alignment.align_texts(sides, texts)
    monkeypatch.setattr(alignment, "TOKENS", 17)
    cut = alignment.align_texts(sides, texts)
    assert all(np.array_equal(whole[0][c], cut[0][c]) for c in whole[0]) and whole[1] == cut[1]
    sums = [Counter() for _ in range(2)]
    for s, (_, _, of, pair, times) in zip(sums, (whole, cut), strict=True):
        for o, p, t in zip(of.tolist(), pair.tolist(), times.tolist(), strict=True):
            s[o, p] += t
        assert (np.diff(of) >= 0).all()
    assert sums[0] == sums[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, BYTES, PIECES).collect() == []
