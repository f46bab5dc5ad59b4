"""Operators that number, pool or match without one task a group, against plain Python; and bases of zero."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from decisa.functions import probs, stats, windows
from decisa.operators import corpus, joins, ranks


def test_no_return_on_a_base_of_zero(spark):
    import datetime

    prices = [0.0, 2.0, -1.0, 4.0, 0.0, 0.0, 3.0]
    rows = [(1, datetime.date(2024, 1, 1) + datetime.timedelta(i), i, x) for i, x in enumerate(prices)]
    df = spark.createDataFrame(rows, "asset int, day date, dn int, close double")
    low, high = windows.forward_extremes("asset", "dn", "close", 2)
    c = F.col("close")
    got = df.select(
        "dn", low.alias("low"), high.alias("high"), windows.relative(windows.contiguous_lead("asset", "day", "close", 1), c).alias("fwd"),
        windows.log_ratio(windows.contiguous_lead("asset", "day", "close", 1), c).alias("log"), windows.distance_from_high("asset", "day", "close", 1).alias("dfh"),
    ).orderBy("dn").collect()
    for i, r in enumerate(got):
        later = prices[i + 1 : i + 3]
        fine = prices[i] > 0 and bool(later)
        assert (r["low"], r["high"]) == ((min(later) / prices[i] - 1, max(later) / prices[i] - 1) if fine else (None, None))
        assert r["fwd"] == (prices[i + 1] / prices[i] - 1 if fine else None)
        assert r["log"] == (pytest.approx(math.log(prices[i + 1] / prices[i])) if fine and prices[i + 1] > 0 else None)
        assert r["dfh"] == (prices[i] / prices[i - 1] - 1 if i and prices[i - 1] > 0 else None)
    vol = windows.realized_volatility(df, "asset", "dn", "close", 2, "vol").collect()
    assert all(r["vol"] is None for r in vol)


def test_wilder_over_a_long_series(spark):
    rng = random.Random(1)
    rows = [("a", i, 10 + rng.random(), 9 + rng.random(), 9.5 + rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t int, hi double, lo double, c double")
    got = {r["t"]: r["atr"] for r in windows.wilder_atr(df, "k", "t", "hi", "lo", "c", 5, "atr").collect()}
    ranges = [max(h - l, abs(h - rows[i - 1][4]), abs(l - rows[i - 1][4])) for i, (_, _, h, l, _) in enumerate(rows) if i]
    atr = sum(ranges[:5]) / 5
    assert got[4] is None and got[5] == pytest.approx(atr)
    for i in range(5, len(ranges)):
        atr = (atr * 4 + ranges[i]) / 5
        assert got[i + 1] == pytest.approx(atr, rel=1e-12)


def test_expanding_quantile_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(40), rng.choice([None, 1.0, 2.0, 2.5, 7.0])) for k in (1, 2, None) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, t int, x double")
    got = sorted(map(str, windows.expanding_quantile_flag(df, "k", "t", "x", 0.8, 3, "flag").collect()))
    want = []
    for k, t, x in rows:
        h = sorted(v for q, s, v in rows if q == k and s < t and v is not None)
        at = 0.8 * (len(h) - 1)
        flag = None if x is None or len(h) < 3 else x > h[math.floor(at)] + (h[math.ceil(at)] - h[math.floor(at)]) * (at - math.floor(at))
        want.append((k, t, x, flag))
    schema = "k int, t int, x double, flag boolean"
    assert got == sorted(map(str, spark.createDataFrame(want, schema).collect()))
    assert windows.expanding_quantile_flag(df.limit(0), "k", "t", "x", 0.8, 3, "flag").collect() == []


@pytest.mark.parametrize("limit", [200_000, 0])
def test_numbered_and_quantiles(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    rows = [(rng.choice(["x", "x", "x", "y", None]), i, rng.choice([None, *[rng.random() for _ in range(4)]])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    got = {r["i"]: (r["place"], r["n"]) for r in ranks.numbered(df, ["g"], [F.desc("v"), F.col("i")], total="n").collect()}
    for g in ("x", "y", None):
        mine = sorted([r for r in rows if r[0] == g], key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [got[i] for _, i, _ in mine] == [(k + 1, len(mine)) for k in range(len(mine))]
    whole = {r["i"]: r["place"] for r in ranks.numbered(df, [], [F.col("i")]).collect()}
    assert whole == {i: i + 1 for i in range(500)}
    for r in ranks.quantile_rows(df, ["g"], "v", {"q": 0.9}).collect():
        h = sorted(v for g, _, v in rows if g == r["g"] and v is not None)
        at = 0.9 * (len(h) - 1)
        assert r["q"] == pytest.approx(h[math.floor(at)] + (h[math.ceil(at)] - h[math.floor(at)]) * (at % 1)) and r["q_rounded"] == h[round(at)]
    assert ranks.numbered(df.limit(0), ["g"], ["i"]).collect() == []


def test_donors_go_round_the_circle(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["u", "u", "u", "a", None]), rng.choice([1, 1, 1, 1, 2, 3]), i) for i in range(400)] + [("alone", 5, 900), ("alone", 5, 901)]
    df = spark.createDataFrame(rows, "role string, conv int, key int").repartition(6)
    got = {r["key"]: r["donor"] for r in joins.donor_join(df, "role", "conv", "key", "s").collect()}
    assert len(got) == len(rows)
    for role in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == role], key=lambda r: (hashlib.sha256(f"s|{r[2]}".encode()).hexdigest(), r[2]))
        for i, (_, conv, key) in enumerate(mine):
            other = [k for _, c, k in mine[i + 1 :] + mine[:i] if c != conv]
            assert got[key] == (other[0] if other else None)


def test_either_key_walks_in_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "hot", *[f"a{k}" for k in range(30)]]), rng.choice([None, "hot", *[f"b{k}" for k in range(40)]])) for i in range(300)] + [(7, "new", "new"), (7, "new", "new")]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(5)
    got = sorted(r["i"] for r in corpus.keep_first_of_either(df, "a", "b", "i").collect())
    a, b, want = set(), set(), []
    for i, x, y in sorted(rows, key=lambda r: r[0]):
        if x not in a and y not in b:
            want.append(i)
            a |= {x} - {None}
            b |= {y} - {None}
    assert got == want
    assert corpus.keep_first_of_either(df.limit(0), "a", "b", "i").collect() == []


@pytest.mark.parametrize("limit", [100_000, 0])
def test_interval_and_overlap_at_any_size(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    rng = random.Random(6)
    folds = [(f"f{i}", s, s + rng.randrange(0, 9)) for i, s in enumerate(rng.choices(range(-20, 60), k=25))]
    rows = [(i, rng.randrange(-25, 70), rng.randrange(0, 6)) for i in range(120)] + [(200, None, 1)]
    df, w = spark.createDataFrame(rows, "i int, t int, n int"), spark.createDataFrame(folds, "fold string, s int, e int")
    got = sorted((r["i"], r["fold"] or "") for r in joins.interval_join(df, w, "t", "s", "e", ["fold"]).collect())
    want = [(i, f) for i, t, _ in rows for f in ([f for f, s, e in folds if t is not None and s <= t < e] or [""])]
    assert got == sorted(want)
    over = joins.overlap_reasons(df.withColumn("end", F.col("t") + F.col("n")), w, "t", "end", "s", "e", "fold").collect()
    assert {r["i"]: r["reasons"] for r in over} == {i: sorted(f for f, s, e in folds if t is not None and t < e and t + n >= s) for i, t, n in rows}


def test_isotonic_in_parts_and_applied(spark):
    rng = random.Random(7)
    rows = [(d, round(p, 3), int(rng.random() < p)) for d in ("x", "y") for p in [rng.random() for _ in range(400)]]
    df = spark.createDataFrame(rows, "d string, p double, y int").repartition(6)
    knots = probs.pava(df, "d", "p", "y")
    steps = {}
    for d in ("x", "y"):
        pool = {}
        for e, p, y in rows:
            if e == d:
                s, w = pool.get(p, (0, 0))
                pool[p] = (s + y, w + 1)
        blocks = []
        for p in sorted(pool):
            blocks.append([*pool[p], p, p])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, w, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
        steps[d] = [(b[2], b[3], b[0] / b[1]) for b in blocks]
        mine = sorted((r["x_low"], r["x_high"], r["value"]) for r in knots.collect() if r["d"] == d)
        assert [m[:2] for m in mine] == [s[:2] for s in steps[d]] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(mine, steps[d], strict=True))
    asks = [(d, x) for d in ("x", "y", "unseen") for x in (-1.0, 0.0, 0.31, 0.5005, 0.77, 1.0, 9.0)]
    for r in probs.apply_isotonic(spark.createDataFrame(asks, "d string, p double"), knots, "d", "p", "out").collect():
        if r["d"] == "unseen":
            assert r["out"] is None
            continue
        s = steps[r["d"]]
        below = [k for k in s if k[0] <= r["p"]]
        if not below:
            want = s[0][2]
        elif r["p"] <= below[-1][1] or len(below) == len(s):
            want = below[-1][2]
        else:
            a, b = below[-1], s[len(below)]
            want = a[2] + (b[2] - a[2]) * (r["p"] - a[1]) / (b[0] - a[1])
        assert r["out"] == pytest.approx(want)


def test_sign_test_and_votes(spark):
    df = spark.createDataFrame([(k, n) for n in (0, 1, 5, 40, 300) for k in (0, 1, n // 2, n, n + 1)], "k long, n long")
    for r in df.withColumn("p", stats.sign_test_p(F.col("k"), F.col("n"))).collect():
        assert r["p"] == pytest.approx(sum(math.comb(r["n"], i) for i in range(max(0, r["k"]), r["n"] + 1)) / 2 ** r["n"], rel=1e-9)
    votes = [(1, "b", "x", 0.5), (1, "a", "y", 0.25), (1, "c", "y", None), (1, "d", None, 1.0), (2, "a", None, 1.0)]
    got = {r["i"]: (r["votes"], r["labels"], r["flips"], r["spread"]) for r in joins.vote_summary(spark.createDataFrame(votes, "i int, r string, l string, s double"), "i", "r", "l", "s").collect()}
    assert got == {1: (4, 2, 1, 0.75), 2: (1, 0, 0, 0.0)}


def test_boosted_stumps_against_plain_python(spark):
    import numpy as np

    from decisa.operators.walkforward import fit_logistic, fit_stumps

    rng = random.Random(8)
    rows = [(a, b, int(rng.random() < (0.9 if a > 0.6 else 0.2))) for a, b in [(round(rng.random(), 2), round(rng.random(), 1)) for _ in range(400)]]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    got = fit_stumps(df, ["a", "b"], "y", 4, 0.5).orderBy("round").collect()
    x, y, score = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]), np.zeros(400)
    assert got[0]["feature"] == "a" and abs(got[0]["threshold"] - 0.6) < 0.08
    for r in got:
        q = 1 / (1 + np.exp(-score))
        g, h, left = q - y, q * (1 - q), x[:, ["a", "b"].index(r["feature"])] <= r["threshold"]
        gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        assert r["gain"] == pytest.approx(gain) and r["left"] == pytest.approx(-0.5 * g[left].sum() / (h[left].sum() + 1))
        score += np.where(left, r["left"], r["right"])
    w = {r["name"]: r["coefficient"] for r in fit_logistic(df, ["a", "b"], "y", 30, 2.0, objective="brier").collect()}
    z, b = np.c_[np.ones(400), (x - x.mean(axis=0)) / x.std(axis=0)], np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ b))
        b -= 2.0 * ((2 * (q - y) * q * (1 - q)) @ z / 400 + 1e-3 * np.array([0, b[1], b[2]]))
    assert [w["intercept"], w["a"], w["b"]] == pytest.approx(b.tolist(), abs=1e-9)


def test_daily_ledger_books_no_incomplete_fill(spark):
    from decisa.operators.panel import daily_ledger

    day = lambda at, **closes: [(at, a, x, x) for a, x in closes.items()]
    rows = day(1, a=1.0, b=2.0, c=3.0, d=4.0) + day(2, a=2.0, b=1.0, c=3.0, d=4.0) + day(3, a=0.0, b=1.0, c=3.0, d=5.0) + day(4, b=1.0)
    got = daily_ledger(spark.createDataFrame(rows, "day int, asset string, score double, close double"), "day", "asset", "score", "close", 1, 3, 10.0).orderBy("day").collect()
    assert [(r["event"], r["changed"], r["cost_bps"]) for r in got] == [("rebalance", 2, 10.0), ("rebalance", 1, 5.0), ("rebalance", 0, 0.0), ("skipped_insufficient_universe", 2, 10.0)]
    # day 2: a short doubled; day 3: b short flat, d long + 25 %; day 4: b flat, d stays at its last close
    assert [r["gross_bps"] for r in got] == pytest.approx([0.0, -5000.0, 1250.0, 0.0])
    lost = daily_ledger(spark.createDataFrame([(1, "a", 1.0, 1.0), (1, "b", 2.0, 2.0), (1, "c", 3.0, 3.0), (2, "a", 1.0, 0.0), (2, "c", 1.0, 3.0)], "day int, asset string, score double, close double"), "day", "asset", "score", "close", 1, 3, 10.0).orderBy("day").collect()
    assert lost[1]["gross_bps"] is None and lost[1]["net_bps"] is None and lost[1]["booked_bps"] == pytest.approx(-20.0)
