"""Prefix packing, hierarchical bootstrap, two-pass pairs, perturbation and the running scorer against plain Python."""

import hashlib
import math
import random
import re

from decisa.functions import text
from decisa.operators import corpus, removal, resample, scorer
from pyspark.sql import functions as F


def test_prefix_packing(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k, [rng.randrange(3) for _ in range(rng.randrange(9))] if k % 17 else None) for k in range(240)] + [("a", 999, [1] * 50)]
    df = spark.createDataFrame(rows, "g string, id long, tokens array<int>")
    got = {(r["g"], r["id"]): (r["block"], r["row"], r["shared"], r["cost"]) for r in removal.pack_prefixes(df, "g", "id", "tokens", 20, 30).collect()}
    want = {}
    for g in ("a", "b", None):
        order = sorted((t or [], i) for x, i, t in rows if x == g)
        row, used, before = -1, 0, []
        for k, (t, i) in enumerate(order):
            same = 0
            while k % 30 and same < min(len(t), len(before)) and t[same] == before[same]:
                same += 1
            if k % 30 == 0:
                row, used, same = 0, 0, 0
            elif used + len(t) - same > 20:
                row, used, same = row + 1, 0, 0
            used += len(t) - same
            want[g, i] = (k // 30, row, same, len(t) - same)
            before = t
    assert got == want
    cost = {}
    for (g, _), (block, row, _, c) in got.items():
        cost[g, block, row] = cost.get((g, block, row), 0) + c
    assert max(v for k, v in cost.items() if v != 50) <= 20
    assert sum(r[2] for r in got.values()) > 100
    assert removal.pack_prefixes(df.limit(0), "g", "id", "tokens", 20).collect() == []


def draw(of, *parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % of


def test_hierarchical_bootstrap_and_contrasts(spark):
    rng = random.Random(3)
    rows = [(arm, seed, g, rng.random() if rng.random() < 0.9 else None) for arm in ("x", "y", "z") for seed in range(rng.randrange(1, 4)) for g in range(rng.randrange(1, 6)) for _ in range(3)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 2.0)], "arm string, seed int, g int, v double")
    means = resample.hierarchical_bootstrap(df, "arm", "seed", "g", F.col("v"), 25, "salt")
    got = {(r["sample"], r["arm"]): r["mean"] for r in means.collect()}
    data = {}
    for arm, seed, g, v in rows:
        if v is not None:
            data.setdefault(arm, {}).setdefault(seed, {}).setdefault(g, []).append(v)
    want = {}
    for b in range(25):
        for arm, seeds in data.items():
            order, s, n = sorted(seeds), 0.0, 0
            for j in range(1, len(order) + 1):
                seed = order[draw(len(order), "salt", b, arm, j)]
                groups = sorted(seeds[seed])
                for i in range(1, len(groups) + 1):
                    values = seeds[seed][groups[draw(len(groups), "salt", b, arm, seed, i)]]
                    s, n = s + sum(values), n + len(values)
            want[b, arm] = s / n
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    c = {r["contrast"]: r for r in resample.contrasts(means, {"d": {"x": 1.0, "y": -1.0}, "none": {"x": 1.0, "q": 1.0}}, 0.1, 0.9).collect()}
    d = sorted(want[b, "x"] - want[b, "y"] for b in range(25))
    assert set(c) == {"d"} and c["d"]["samples"] == 25 and math.isclose(c["d"]["low"], d[2]) and math.isclose(c["d"]["high"], d[22])


def test_two_pass_pairs(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([0, 1, 1, 2, None] if k % 3 == 0 else [0, 0, 1]), "a" if k % 3 == 0 else rng.choice(["b", None]), rng.choice(["x", "y", None])) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, y int, a string, b string")
    got = {(r["positive"], r["negative"], r["passed"]) for r in corpus.two_pass_pairs(df, "id", "y", ["a", "b"], ["b"]).collect()}
    left, want = [r for r in rows if r[1] in (0, 1)], set()
    for number, key in ((1, lambda r: (r[2], r[3])), (2, lambda r: r[3])):
        for k in {key(r) for r in left}:
            sides = [sorted(r[0] for r in left if key(r) == k and r[1] == y) for y in (1, 0)]
            want |= {(p, n, number) for p, n in zip(*sides, strict=False)}
        used = {i for p, n, _ in want for i in (p, n)}
        left = [r for r in left if r[0] not in used]
    assert got == want and len({i for p, n, _ in got for i in (p, n)}) == 2 * len(got) and {n for _, _, n in got} == {1, 2}


def test_perturbation_changes_one_span(spark):
    texts = ["see src/a/b.py and v1.2.3 or 12.5, 9", "no spans here", None, "", "99", "a/b", "x v2.0.9 y", "é 7é 8", "dir/.hidden", "a//b/c.tar.gz"]
    pattern = "|".join(p for _, p in text.SPANS)
    df = spark.createDataFrame([(i, t, d) for i, t in enumerate(texts) for d in range(5)], "i int, t string, d long")
    for r in df.select("i", "d", text.perturbed(F.col("t"), F.col("d")).alias("p")).collect():
        t, p = texts[r["i"]], r["p"]
        found = list(re.finditer(pattern, t or ""))
        if not found:
            assert p is None
            continue
        m = found[r["d"] % len(found)]
        assert (p["start"], p["before"]) == (m.start(), m.group()) and p["after"] != p["before"] and p["text"] == t[: m.start()] + p["after"] + t[m.end() :]
        if p["kind"] == "path":
            head, last = m.group().rsplit("/", 1)
            name, dot, rest = last.partition(".")
            assert p["after"] == f"{head}/{name}_x{dot}{rest}"
        else:
            assert p["after"] == m.group()[:-1] + str((int(m.group()[-1]) + 1) % 10)
            assert p["kind"] == ("version" if m.group().count(".") > 1 else "number")


def test_scorer_answers_whole_requests(spark):
    rows = [(k, f"c{j}", "why? 12" if j else None) for k in range(40) for j in range(1 + k % 3)]
    df = spark.createDataFrame(rows, "k int, id string, t string")

    def faulty():
        good = scorer.logistic_scorer([0.5, 0.1, 1.0, -1.0])()

        def run(ids, texts):
            answers = good(ids, texts)
            if len(ids) == 2:
                raise RuntimeError("down")
            if len(ids) == 3:
                answers[ids[1]] = {"true": 0.5}
            return answers

        return run

    got = scorer.answered(df, "k", "id", "t", faulty).collect()
    assert {(len([r for r in rows if r[0] == g["k"]]), g["reason"], len(g["scores"])) for g in got} == {(1, None, 1), (2, "scorer_error", 0), (3, "wrong_labels", 0)}
    p = 1 / (1 + math.exp(-0.5))
    assert all(math.isclose(g["scores"][0]["p"], p) for g in got if g["reason"] is None) and len(got) == 40
    fine = scorer.answered(df, "k", "id", "t", scorer.logistic_scorer([0.0, 0.0, 1.0, -1.0])).filter("k = 2").first()
    assert [s["id"] for s in fine["scores"]] == ["c0", "c1", "c2"] and math.isclose(fine["scores"][1]["p"], 1 / (1 + math.exp(-(2 / 7 - 1 / 7))))
