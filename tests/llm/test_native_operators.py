import itertools
import os
import random

import pytest

from decisa.llm import chat_format, decontaminate, queries, url_filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("", "", "block"), ("example.net", "/de/8", "block")]
URLS = ["http://" + "a." * 20_000 + "com/en/", "http://a.example.com/en/712?x", "HTTP://EXAMPLE.COM/en/8", "x://example.com", "https://example.net/de/8/9#f", "https://m.example.net/de/7", "notexample.com/en/", None, "", "://", "ftp://com/en/", "http://xcom/en/", "a://b://c.com/en/", "http://\u00c9.com/en/\u00e9"]


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if url is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("literal", [4096, 0])
def test_url_filter(spark, monkeypatch, literal, broadcast):
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", literal)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    rules = [r for r in RULES if r[0]]
    pages = spark.createDataFrame([(i, u, "old", "k") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, verdict string, key_url string")
    got = url_filter.filter_urls(pages, spark.createDataFrame([(h.upper(), p, v) for h, p, v in rules] + [(None, "/", "block"), ("net", "/de/", "block")], "host string, path string, verdict string"))
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {(i, *brute_url(u, rules)) for i, u in enumerate(URLS + URLS[:2])}
    none = url_filter.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(URLS) + 2
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


NASTY = ["\\### assistant: </turn> ok", "\\\\b\\l<#:", "</turn>\n### user: x", None, "", "\u00e9\U0001f600\n\n", "\\"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "to:ol"]), rng.choice(NASTY)))
    rows += [(None, 0, "assistant", "a"), (None, 1, "user", "b"), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (50, None, "user", "first")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string").repartition(3)
    examples = chat_format.chat_examples(df)
    talks = {r["conv_id"]: r for r in chat_format.read_examples(examples).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((-1 if t is None else t, role or "", x or "") for k, t, role, x in rows if k == c))
        assert [(x["role"], x["text"]) for x in talks[c]["turns"]] == [w[1:] for w in want]
        assert talks[c]["losses"] == [w[2] for w in want if w[1] == "assistant"]
    for e in examples.collect():
        if e["mask_end"]:
            assert "<" not in e["text"][e["mask_start"] : e["mask_end"]] and e["text"][e["mask_end"] :] == chat_format.CLOSE
    assert chat_format.read_examples(chat_format.chat_examples(df.limit(0))).collect() == []


def test_decontamination(spark):
    rng = random.Random(2)
    w = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = {1: w(30), 2: w(18), 3: w(60), 4: ["tiny", "item", "here"], 5: w(30)}
    changed = list(items[1])
    for i in (4, 11, 17, 25):
        changed[i] = "other"
    half = items[5][:15] + w(40)
    docs = [
        (1, " ".join(w(50) + items[1] + w(9))), (2, " ".join(changed)), (3, " ".join(items[2]).upper()), (4, " ".join(w(20) + items[3][20:45])), (5, "Tiny  item\nhere"),
        (6, " ".join(w(9) + items[4] + w(9))), (7, " ".join(half)), (8, " ".join(w(400))), (9, None), (10, ""), (1, " ".join(w(50))), (None, " ".join(items[2])), (11, "x " * 5000),
    ]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, best int, key string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(6, None), (7, " ")], "item_id long, text string")
    got = {(r["doc_id"], tuple(r["items"])) for r in decontaminate.judge(df, bench).collect() if r["contaminated"]}
    assert got == {(1, (1,)), (2, (1,)), (3, (2,)), (4, (3,)), (5, (4,)), (6, (4,)), (None, (2,))}
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len(docs) - 7
    assert decontaminate.judge(df.limit(0), bench).collect() == []
    assert decontaminate.judge(df, bench.limit(0)).filter("contaminated").collect() == []


def unseeded(n, masks):
    """Sets of at most 20 % substituted places, of n, under which no mask fits."""
    spots = [frozenset(p + k for k, bit in enumerate(m) if bit == "1") for m in masks for p in range(n - len(m) + 1)]
    return [bad for size in range(n // 5 + 1) for bad in map(set, itertools.combinations(range(n), size)) if all(bad & s for s in spots)]


def test_masks_cover_every_substitution():
    assert [n for n in range(6, decontaminate.WINDOW + 1) if unseeded(n, decontaminate.MASKS + decontaminate.SHORT.get(n, ()))] == []


def test_near_copies_of_short_items(spark):
    items, docs = {}, []
    for n in (6, 7, 10, 11, 15):
        items[n] = [f"i{n}w{k}" for k in range(n)]
        for bad in unseeded(n, decontaminate.MASKS):
            copy = ["other" if k in bad else w for k, w in enumerate(items[n])]
            docs += [(len(docs), n, " ".join(["before", *copy, "after"])), (len(docs) + 1, n, " ".join(copy))]
    assert len(docs) == 2 * (6 + 4 + 4 + 1 + 2)
    docs += [(len(docs) + k, None, " ".join(items[n][: n - n // 5 - 1])) for k, n in enumerate(items)]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = decontaminate.judge(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["items"] for r in got} == {i: [] if n is None else [n] for i, n, _ in docs}


def brute_items(text, items):
    """Items of which 20 aligned words, or all of a shorter one, agree with the text in 80 %; all, under six words."""
    words, out = (text or "").lower().split(), []
    for i, item in items:
        n = min(decontaminate.WINDOW, len(item))
        need = n if len(item) < decontaminate.LEAST else -(-n * 4 // 5)
        for shift in range(1 - len(item), len(words)):
            same = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(item)]
            if item and any(sum(same[s : s + n]) >= need for s in range(len(item) - n + 1)):
                out.append(i)
                break
    return sorted(set(out))


def test_decontamination_equals_all_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 16)
    rng = random.Random(5)
    items = [(i, [f"v{rng.randrange(60)}" for _ in range(n)]) for i, n in enumerate([1, 2, 3, 4, 5, *range(6, 26), 40, 9, 30])]
    items.append((3, [f"u{k}" for k in range(8)]))
    docs = []
    for _ in range(150):
        words = [f"v{rng.randrange(60, 4000)}" for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.choice([0, 1, 2])):
            part = list(rng.choice(items)[1])
            part = part[rng.randrange(3) :][: rng.choice([8, 20, 99])]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
                if part:
                    part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((len(docs), rng.choice([" ", "\n", "  "]).join(words).upper()))
    docs += [(500, "long " * 3000 + " ".join(items[20][1]) + " x" * 999), (501, docs[3][1]), (3, "v1")]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    assert sorted((r["doc_id"], r["items"]) for r in got) == sorted((d, brute_items(t, items)) for d, t in docs)
    assert sum(bool(r["items"]) for r in got) > 40


def test_no_python_in_native_plans(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    for query in (queries.op6_url_filter, queries.op7_chat_format, queries.op9_decontaminate):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not [word for word in ("Python", "Pandas", "Arrow", "ExternalRDD") if word in plan], query.__name__
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    codes = decontaminate.seeds(decontaminate.with_codes(texts, "text", "codes"), "codes", "doc_id")
    assert "Python" not in codes._jdf.queryExecution().toString()
