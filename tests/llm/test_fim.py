import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from decisa.llm import fim


def plain_example(key, text, marks=fim.SENTINELS, fim_rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= fim_rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def texts():
    rng = random.Random(5)
    passage = "".join(rng.choices("abcd é\n", k=6000))
    out = [None, "", "\n", "x", "no end", "<P>", "a<S>b", "<M", "<", "q<\n", "é\n日本\n" * 700, "z" * 40_000, "\n" * 3000, passage, "b" + passage, passage + "<M>", passage * 3]
    out += ["".join(rng.choices(["a", "\n", "<", "P", ">", "S", "M", "é"], k=rng.randrange(60))) for _ in range(300)]
    return out


@pytest.mark.parametrize(("longest", "bits", "window"), [(1 << 14, 10, 16), (5, 2, 4), (1, 1, 2)])
def test_chunks_give_lines_and_characters(monkeypatch, longest, bits, window):
    monkeypatch.setattr(fim, "LONGEST", longest)
    monkeypatch.setattr(fim, "CHUNK_BITS", bits)
    monkeypatch.setattr(fim, "WINDOW", window)
    import numpy as np

    some = [(t or "").encode() for t in texts()]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in some])))
    ends, room = fim.chunk_ends(b"".join(some), starts), [1 << 16]
    marks = fim._check(fim.SENTINELS)
    fim._chunks.clear()
    for i, t in enumerate(some):
        own = ends[np.searchsorted(ends, starts[i], "right") : np.searchsorted(ends, starts[i + 1], "right")] - starts[i] if t else []
        got = fim._example(t, list(map(int, own)), i, 7, 100, 50, marks, room)
        assert (*got[:4], got[4].decode()) == plain_example(i, t.decode())


def test_shared_passages_share_chunks():
    import numpy as np

    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 60_000).astype(np.uint8))
    joined = b"short lead " + passage + b"another and longer lead here " + passage
    starts = np.array([0, 11 + len(passage), len(joined)])
    ends = fim.chunk_ends(joined, starts).tolist()
    chunks = [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert len(chunks) > 60 and len(chunks) - len(set(chunks)) >= len(chunks) // 2 - 3


def test_examples_and_restored_texts(spark):
    rows = [(None if k == 3 else k % 200, t, "extra") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(5)
    out = fim.fim_examples(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    both = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([tuple(r)[:6] for r in both], key=str) == sorted([(k, *plain_example(k, t)) for k, t, _ in rows], key=str)
    assert sorted(r["back"] for r in both) == sorted(t or "" for _, t, _ in rows)
    assert {r["form"] for r in both} == {"plain", "psm", "spm"}


def test_rates_sentinels_and_empty_table(spark):
    marks = ("[PRE]", "{SUF}", "(MID)")
    docs = spark.createDataFrame([(k, f"{k}\nline <P>\n[PR") for k in range(200)], "doc_id int, text string")
    out = fim.fim_examples(docs, fim_rate=40, spm_rate=10, sentinels=marks)
    assert sorted(map(tuple, out.collect())) == sorted((k, *plain_example(k, f"{k}\nline <P>\n[PR", marks, 40, 10)) for k in range(200))
    assert out.filter(fim.restored(F.col("output"), F.col("form"), marks) != F.concat(F.col("doc_id").cast("string"), F.lit("\nline <P>\n[PR"))).count() == 0
    assert fim.fim_examples(docs.limit(0)).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "x<", "<M>"), ("", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.fim_examples(docs, sentinels=bad)
    assert docs.select(fim.restored(F.lit("no marks"), F.lit("psm")).alias("x")).distinct().collect() == [(None,)]
