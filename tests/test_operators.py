"""Operators on tiny tables with known answers, ties and gaps; properties from the survey's traps."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from decisa.functions import probs, stats, text, windows
from decisa.operators import asof, corpus, joins, panel, removal, resample, validate, walkforward
from decisa.sources import readers, sinks


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket", [None, 3])
def test_asof_ties_follow_the_bound(spark, bucket):
    asks = spark.createDataFrame([("a", 5), ("a", 4), ("a", 99), ("b", 5)], "k string, t long")
    facts = spark.createDataFrame([("a", 3, 0.1), ("a", 5, 0.2), ("a", 50, 0.3)], "k string, t long, v double")
    loose = asof.asof_join(asks, facts, ["k"], "t", "t", ["v"], bucket=bucket)
    strict = asof.asof_join(asks, facts, ["k"], "t", "t", ["v"], strict=True, bucket=bucket)
    ahead = asof.asof_join(asks, facts, ["k"], "t", "t", ["v"], forward=True, bucket=bucket)
    assert rows(loose, "k", "t", "v") == [("a", 4, 0.1), ("a", 5, 0.2), ("a", 99, 0.3), ("b", 5, None)]
    assert rows(strict, "k", "t", "v") == [("a", 4, 0.1), ("a", 5, 0.1), ("a", 99, 0.3), ("b", 5, None)]
    assert rows(ahead, "k", "t", "v") == [("a", 4, 0.2), ("a", 5, 0.2), ("a", 99, None), ("b", 5, None)]


def test_leaky_selector_is_caught(spark):
    """A forward join used where a backward one belongs shows prices later than the decision."""
    asks = spark.createDataFrame([("a", 5)], "k string, t long")
    facts = spark.createDataFrame([("a", 4, 4), ("a", 6, 6)], "k string, t long, seen long")
    good = asof.asof_join(asks, facts, ["k"], "t", "t", ["seen"]).first()
    leaky = asof.asof_join(asks, facts, ["k"], "t", "t", ["seen"], forward=True).first()
    assert good["seen"] <= good["t"] and leaky["seen"] > leaky["t"]


def test_gaps_break_lags(spark):
    df = spark.createDataFrame([("a", day(k), float(k)) for k in (0, 1, 2, 4, 5)], "k string, d date, v double")
    got = df.select("d", windows.contiguous_lag("k", "d", "v", 1).alias("b"), windows.contiguous_lead("k", "d", "v", 1).alias("f"), windows.moving_average("k", "d", "v", 2).alias("m"))
    assert [tuple(r)[1:] for r in got.orderBy("d").collect()] == [(None, 1.0, None), (0.0, 2.0, 0.5), (1.0, None, 1.5), (None, 5.0, None), (4.0, None, 4.5)]


def test_two_trailing_windows_differ(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, None, 3.0, None, 2.0, 2.0])], "k string, t int, v double")
    a = windows.trailing_mid_rank(df, "k", "t", "v", 2, 1, "p").orderBy("t").collect()
    b = windows.trailing_mid_rank_non_null(df, "k", "t", "v", 2, 1, "p").orderBy("t").collect()
    assert [r["p"] for r in a] == [None, None, 1.0, None, 0.0, 0.5]
    assert [r["p"] for r in b] == [None, None, 1.0, None, 0.5, 0.25]


def test_labels_ignore_later_rows(spark):
    rng = random.Random(1)
    data = [("a", k, rng.random()) for k in range(60)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    part = windows.expanding_quantile_flag(df.filter("t < 40"), "k", "t", "v", 0.8, 5, "hot")
    whole = windows.expanding_quantile_flag(df, "k", "t", "v", 0.8, 5, "hot").filter("t < 40")
    assert rows(part, "t", "hot") == rows(whole, "t", "hot")


def test_streaks_and_atr(spark):
    df = spark.createDataFrame([("a", day(k), f) for k, f in ((0, True), (1, True), (3, True), (4, False), (5, True))], "k string, d date, f boolean")
    assert [r["s"] for r in windows.streak(df, "k", "d", "f", "s").orderBy("d").collect()] == [1, 2, 1, 0, 1]
    bars = spark.createDataFrame([("a", k, 10.0 + k, 8.0 + k, 9.0 + k) for k in range(6)], "k string, t int, h double, l double, c double")
    assert [r["x"] for r in windows.wilder_atr(bars, "k", "t", "h", "l", "c", 3, "x").orderBy("t").collect()] == [None, None, None, 2.0, 2.0, 2.0]


def test_quantiles_and_tests(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    got = x.agg(F.percentile("x", 0.25).alias("a"), F.expr("percentile_disc(0.95) within group (order by x)").alias("b"), stats.rounded_rank_quantile(F.collect_list("x"), 0.5).alias("c")).first()
    assert tuple(got) == (1.75, 4.0, 3.0)
    assert abs(spark.range(1).select(stats.erf(F.lit(0.5))).first()[0] - 0.5204998778) < 2e-7
    assert abs(spark.range(1).select(stats.sign_test_p(F.lit(8), F.lit(10))).first()[0] - 56 / 1024) < 1e-12
    p = spark.createDataFrame([("f", "a", 0.04), ("f", "b", 0.03), ("f", "c", 0.9)], "g string, n string, p double")
    assert rows(stats.benjamini_hochberg(p, ["g"], "p", "n"), "n", "passes") == [("a", False), ("b", False), ("c", False)]
    k = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert stats.kappa(k, "a", "b").first()["kappa"] is None


def test_ridge_grams_give_the_fit(spark):
    rng = random.Random(2)
    data = [(x, z, 1 + 2 * x - 3 * z) for x, z in ((rng.random(), rng.random()) for _ in range(50))]
    row = stats.ridge_grams(spark.createDataFrame(data, "x double, z double, y double"), [], ["x", "z"], "y").first()
    assert [round(c, 6) for c in stats.ridge_solve(row, 2, 0.0)] == [1.0, 2.0, -3.0]


def test_calibration(spark):
    rng = random.Random(3)
    data = [(i, p, int(rng.random() < p**2 / (p**2 + (1 - p) ** 2))) for i in range(3000) for p in [rng.uniform(0.05, 0.95)]]
    df = spark.createDataFrame(data, "id int, p double, y int").withColumn("d", F.lit("x"))
    assert abs(probs.fit_temperature(df, "p", "y") - 0.5) < 0.05
    a, b = probs.fit_platt(df, "p", "y")
    assert abs(a - 2) < 0.2 and abs(b) < 0.15
    knots = probs.pava(df.withColumn("p", F.round("p", 1)), "d", "p", "y").orderBy("x_low").collect()
    values = [k["value"] for k in knots]
    assert values == sorted(values) and sum(k["weight"] for k in knots) == 3000
    curve = probs.coverage_risk(df.withColumn("ok", F.lit(True)), [], "p", "ok").orderBy("threshold").collect()
    assert len(curve) == 101 and all(x["coverage"] >= y["coverage"] for x, y in zip(curve, curve[1:], strict=False))


def test_argmax_ties(spark):
    r = spark.range(1).select(F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5)).alias("m"))
    got = r.select(probs.argmax_first(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.5), F.lit(0.5))), probs.argmax_largest_key(F.col("m"))).first()
    assert tuple(got) == ("a", "b")


def test_joins_that_refuse(spark):
    a, b = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k int, v double"), spark.createDataFrame([(1, 0.7)], "k int, v double")
    with pytest.raises(Exception, match="differ"):
        joins.matched_pairs(a, b, ["k"], ["v"]).collect()
    with pytest.raises(ValueError):
        joins.assert_isolated(a, b, ["k"])
    joins.assert_isolated(a, b.filter("k > 5"), ["k"])
    with pytest.raises(ValueError):
        joins.overlay_labels(b, a.withColumn("t", F.lit(1)), "k", ["v"], ["t"])
    with pytest.raises(ValueError):
        validate.check_folds([("a", 0, 10), ("b", 9, 20)])
    validate.check_folds([("a", 0, 10), ("b", 10, 20)], 20)


def test_donors_are_of_another_group(spark):
    df = spark.createDataFrame([(i, "r", i % 3) for i in range(30)] + [(99, "alone", 1)], "key int, role string, g int")
    groups = {r["key"]: r["g"] for r in df.collect()}
    for r in joins.donor_join(df, "role", "g", "key", "s").collect():
        assert (r["donor"] is None) == (r["key"] == 99) and (r["donor"] is None or groups[r["donor"]] != r["g"])


def test_components_and_closure(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (5, 5)], "a int, b int")
    assert {r["component"] for r in joins.components(edges, "a", "b").collect()} == {1, 100}
    deps = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("h", 1, 9)], "group string, src int, dst int")
    seeds = spark.createDataFrame([("g", 1)], "group string, node int")
    assert rows(joins.closure(deps, seeds), "group", "node") == [("g", 1), ("g", 2), ("g", 3)]


def test_sequential_dedup_and_windows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice("abcdefgh"), rng.choice("stuvwxyz")) for i in range(30)]
    seen_a, seen_b, want = set(), set(), []
    for i, a, b in data:
        if a not in seen_a and b not in seen_b:
            want.append(i)
            seen_a.add(a)
            seen_b.add(b)
    got = corpus.keep_first_of_either(spark.createDataFrame(data, "i int, a string, b string").repartition(4), "a", "b", "i")
    assert sorted(r["i"] for r in got.collect()) == want
    turns = spark.createDataFrame([(1, k, c, k == 4) for k, c in enumerate([5, 50, 6, 7, 10])], "g int, pos int, cost int, anchor boolean")
    assert tuple(corpus.nearest_window(turns, ["g"], "pos", "cost", "anchor", 30).first()[1:]) == (28, [0, 2, 3, 4])


def test_fifo_skips_early_results(spark):
    kinds = "cuucuccu"
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate(kinds)], "g int, pos int, kind string")
    waiting, want = [], []
    for k, c in enumerate(kinds):
        if c == "u":
            waiting.append(k)
        elif waiting:
            want.append((waiting.pop(0), k))
    assert rows(corpus.fifo_pairs(df, ["g"], "pos", "kind", "u", "c"), "open_pos", "close_pos") == sorted(want)


def test_legs_skip_flat_days(spark):
    df = spark.createDataFrame([(1, a, float(a)) for a in range(30)] + [(2, a, 1.0) for a in range(30)] + [(3, a, float(a)) for a in range(5)], "d int, a int, s double")
    book = panel.legs(df, "d", "a", "s")
    assert {r["d"] for r in book.collect()} == {1} and book.count() == 6


def test_placebo_keeps_values(spark):
    df = spark.createDataFrame([(g, k, float(k)) for g in range(3) for k in range(20)], "g int, k int, v double")
    out = resample.placebo(df, ["g"], "k", "v", "s", "w")
    assert rows(out, "g", "w") == rows(df, "g", "v") and rows(out, "g", "k", "w") != rows(df, "g", "k", "v")


def test_text_functions(spark):
    t = spark.createDataFrame([("A  B\n c 12",)], "x string")
    got = t.select(text.normalize(F.col("x")), text.boilerplate_key(F.col("x")), text.word_estimate(F.lit("  ")), text.digest_mod(F.lit("k"), 1000), text.pointer_index(F.lit("/messages/12/content/0/text"))).first()
    import hashlib

    assert tuple(got) == ("a b c 12", "a b c ##", 0, int(hashlib.sha256(b"k").hexdigest(), 16) % 1000, 12)
    for bad, kind in (("key AKIA" + "A" * 16, "aws_key"), ("mail a@b.co", "email"), ("plain", None)):
        assert spark.range(1).select(text.secret_kind(F.lit(bad))).first()[0] == kind


def test_strict_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n{"a": NaN}\n{bad\n')
    got = {r["value"]: r["fault"] for r in readers.read_strict_jsonl(spark, str(tmp_path / "x.jsonl")).collect()}
    assert {k for k, v in got.items() if v is None} == {'{"a": 1}'} and len(got) == 4
    good, counts = readers.read_log(spark, str(tmp_path / "x.jsonl"), "a double")
    assert {r["malformed"]: r["n"] for r in counts.collect()}[True] >= 1 and good.count() >= 1
    with zipfile.ZipFile(tmp_path / "BTC-1.zip", "w") as z:
        z.writestr("m.csv", "open_time,open\n1,1,2,0.5,1.5,10,2\nshort\n2,1,2,0.5,1.6,10,3\n")
    with zipfile.ZipFile(tmp_path / "BTC-2.zip", "w") as z:
        z.writestr("m.csv", "2,1,2,0.5,9.9,10,3\n")
    assert rows(readers.read_zipped_bars(spark, str(tmp_path / "*.zip")), "symbol", "open_time", "close") == [("BTC", 1, 1.5), ("BTC", 2, 9.9)]
    for n, i in (("train", 1), ("dev", 2)):
        (tmp_path / f"{n}.jsonl").write_text(json.dumps({"id": i, "g": "same"}) + "\n")
    with pytest.raises(ValueError):
        readers.read_splits(spark, str(tmp_path), ["train", "dev"], "id long, g string", "g")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "ledger")
    assert [sinks.append_unseen(df, path, ["k"]), sinks.append_unseen(df, path, ["k"])] == [2, 0]
    sinks.write_jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.write_jsonl(df, str(tmp_path / "out"))
    m = sinks.manifest(spark, str(tmp_path / "out"))
    m.write.parquet(str(tmp_path / "manifest"))
    assert sinks.verify_manifest(spark, str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "manifest"))).collect() == []
    holes = spark.createDataFrame([(None, None, "x"), (None, 1, "y"), (1, None, "z"), (1, None, "a")], "k int, j int, v string")
    path = str(tmp_path / "null-keys")
    assert [sinks.append_unseen(holes, path, ["k", "j"]) for _ in range(3)] == [3, 0, 0]
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, holes.filter("v <> 'z'").collect()))
    for _ in range(3):
        sinks.write_remaining(holes.filter("v < 'z' and v > 'a'"), str(tmp_path / "null-shards"), "k", 3)
    assert spark.read.parquet(str(tmp_path / "null-shards")).count() == 2
    sly = [spark.createDataFrame([r], "a string, b string") for r in (("x\x1fy", "z"), ("x", "y\x1fz"), ("\x00", "z"), (None, "z"))]
    assert len({sinks.receipt(x).first() for x in sly}) == 4
    assert sinks.receipt(df).first() == sinks.receipt(df.orderBy(F.desc("k"))).first()
    assert "| 2 | b |" in sinks.markdown(df, [F.desc("k")])


def test_validators(spark):
    q = spark.createDataFrame([("boolean", None), ("choice", ["a"]), ("choice", ["a", " "]), ("score", ["a", "b"]), ("odd", ["a", "b"])], "kind string, criteria array<string>")
    assert [r[0] for r in q.select(validate.question_reason("kind", "criteria")).collect()] == [None, "criteria_count", "blank_criterion", None, "unknown_type"]
    links = spark.createDataFrame([(1, 0, "call", "x"), (1, 1, "result", "x"), (2, 0, "result", "y"), (2, 1, "call", "y"), (3, 0, "call", "z")], "g int, pos int, kind string, id string")
    assert rows(validate.tool_link_reason(links, ["g"], "pos", "kind", "id"), "g", "reason") == [(1, None), (2, "orphan_result"), (3, "pending_call")]


def test_walk_forward_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    d = np.repeat(np.arange(20), 15)
    x = rng.normal(size=(300, 2))
    y = 0.5 + x @ [1.0, -2.0] + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(int(a), i % 15, float(p), float(q), float(t)) for i, (a, (p, q), t) in enumerate(zip(d, x, y, strict=True))], "d long, k int, x1 double, x2 double, y double")

    def ridge(rows, lam):
        a = np.column_stack([np.ones(rows.sum()), x[rows]])
        return np.linalg.solve(a.T @ a + lam * np.diag([0, 1, 1]), a.T @ y[rows])

    got = {(r["d"] if "d" in r else r["day"], r["k"]): r["pred"] for r in walkforward.scored_ledger(df, "d", "k", ["x1", "x2"], "y", 10, 1.0).collect()}
    for i in np.flatnonzero(d >= 10):
        b = ridge(d < d[i], 1.0)
        assert abs(got[(int(d[i]), int(i % 15))] - (b[0] + x[i] @ b[1:])) < 1e-6
    lam = walkforward.select_lambda(df, "d", ["x1", "x2"], "y", [0.0, 1e6])
    assert [r["chosen"] for r in lam.orderBy("lam").collect()] == [True, False]
    fold = walkforward.evaluate_fold(df, "d", "k", ["x1", "x2"], "y", 12, 1.0).first()
    assert fold["mse_ratio"] < 0.05 and fold["rho"] > 0.9
    policies = {r["policy"]: r for r in walkforward.refit_policies(df, "d", ["x1", "x2"], "y", 10, 5, 10, 1.0).collect()}
    assert policies["frozen"]["drift"] == 0.0 and policies["rolling"]["n"] == 150
    z = spark.createDataFrame([(float(a), int(b > 0)) for a, b in zip(x[:, 0], x[:, 0] + 0.3 * x[:, 1], strict=True)], "x1 double, y int")
    assert {r["name"]: r["coefficient"] for r in walkforward.fit_logistic(z, ["x1"], "y", 20, 1.0).collect()}["x1"] > 1


def test_removal_and_packing(spark):
    df = spark.createDataFrame([(1, k, "t" * (k + 1) if k != 3 else None) for k in range(7)], "g int, pos int, text string")
    assert tuple(removal.prove(df, "g", "pos", "text", F.col("pos") % 2 == 1).first()) == (1, True, 3, 7)
    costs = df.withColumn("c", F.lit(4))
    assert [(r["first"], r["last"], r["used"]) for r in removal.pack(costs, "g", "pos", "c", 9).orderBy("row").collect()] == [(0, 1, 8), (2, 3, 8), (4, 5, 8), (6, 6, 4)]


def test_expanding_quantile_is_that_of_the_sql(spark):
    history = [16.03, 17.92, 23.64, 29.87, 43.24, 44.04, 57.66]  # low + (high - low) * d is 43.88 itself
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate([*history, 43.88])], "k string, t int, v double")
    got = windows.expanding_quantile_flag(df, "k", "t", "v", 0.8, 5, "hot").filter("t = 7").first()
    assert got["hot"] is True  # as quantile_cont(h, 0.8) < 43.88 in DuckDB
