"""Operators that were moved off single tasks, and the readers of labels and open corpora."""

import random

import pytest
from pyspark.sql import functions as F

from decisa.operators import corpus, joins, ranks, removal
from decisa.sources import readers


def test_closure_in_one_task_or_in_rounds(spark):
    rng = random.Random(1)
    edges = [(g, rng.randrange(30), rng.randrange(30)) for g in "abc" for _ in range(25)] + [("chain", k, k + 1) for k in range(60)]
    seeds = [(g, k) for g in "abd" for k in (1, 2)] + [("chain", 0)]
    e, s = spark.createDataFrame(edges, "group string, src long, dst long"), spark.createDataFrame(seeds, "group string, node long")
    want = set(seeds)
    while True:
        more = want | {(g, y) for g, x, y in edges if (g, x) in want}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in joins.closure(e, s).collect()} == want
    small = e.filter("group <> 'chain'")
    assert {tuple(r) for r in joins.closure(small, s, at_once=1).collect()} == {x for x in want if x[0] != "chain"} | {("chain", 0)}


def test_average_ranks_and_packing(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.5, None])) for _ in range(80)]
    got = ranks.average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "r").collect()
    for r in got:
        group = [v for g, v in rows if g == r["g"] and v is not None]
        assert r["r"] == (sum(v < r["v"] for v in group) + 1 + sum(v <= r["v"] for v in group)) / 2
    assert len(got) == sum(v is not None for _, v in rows)
    t = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 11), ("a", 1, None), ("a", 2, 4)], "k string, p int, c int")
    assert sorted(map(str, map(tuple, removal.pack(t, "k", "p", "c", 10).collect()))) == ["('a', 0, 1, 2, 4)", "('a', 1, 3, 3, 11)", "(None, 0, 1, 1, 5)", "(None, 1, 2, 2, 6)"]
    times = spark.createDataFrame([("a", 1), ("a", 4), ("a", 5), ("a", 5), (None, 3), ("b", None)], "k string, t int")
    assert sorted(map(str, map(tuple, corpus.spaced(times, ["k"], "t", 4).collect()))) == ["('a', 1)", "('a', 5)", "(None, 3)"]


def test_label_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text('﻿Record_ID, Label of owner ,Evidence\nr1, YES ,"two\nlines"\nr2,?,\nr3,,x\n,yes,\nr4,hm,\nr1,,later\n')
    got = {r["record_id"]: (r["label"], r["note"], r["fault"]) for r in readers.read_label_csv(spark, str(tmp_path / "one.csv")).collect()}
    assert got == {"r1": ("true", "two\nlines", None), "r2": ("uncertain", None, None), "r3": (None, "x", "empty"), "r4": (None, None, "unrecognized")}
    (tmp_path / "two.csv").write_text("id,label\n1,yes\n")
    with pytest.raises(ValueError, match="record_id"):
        readers.read_label_csv(spark, str(tmp_path / "two.csv"))


def test_contract_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1,2\nbad,3\n")
    (tmp_path / "b.csv").write_text("y,x\n8,9\n")
    (tmp_path / "c.csv").write_text("x,y,z\n3,4,5\n")
    assert [tuple(r) for r in readers.read_contract_csv(spark, str(tmp_path), ["x", "y"], "x int, y int").filter("x is not null").collect()] == [(1, 2)]


def test_open_histories(spark):
    def talk(*roles):
        return [(r, f"t{i}") for i, r in enumerate(roles)]

    cases = {
        "fine": talk("system", "human", "gpt", "human", "gpt", "human", "gpt"), "tool": talk("user", "assistant", "user", "gpt", "function"), "short": talk("human", "gpt", "human", "gpt"),
        "early": talk("user", "user", "gpt", "user", "user"), "odd": [*talk("human", "gpt", "moderator", "human", "gpt"), ("human", " "), ("human", "end"), ("human", "more")], "two answers": talk("human", "gpt", "human", "human", "gpt", "gpt"),
    }
    rows = [(k, i, r, t) for k, m in cases.items() for i, (r, t) in enumerate(m)]
    got = {r["k"]: ([tuple(m) for m in r["messages"]], r["reference"], r["eligible"]) for r in corpus.open_histories(spark.createDataFrame(rows, "k string, i int, r string, t string"), "k", "i", "r", "t").collect()}
    assert set(got) == {"fine", "tool", "odd"}
    assert got["fine"] == ([("system", "t0"), ("user", "t1"), ("assistant", "t2"), ("user", "t3"), ("assistant", "t4"), ("user", "t5")], "t6", ["/messages/2/content"])
    assert got["tool"][1:] == (None, ["/messages/1/content"])
    assert got["odd"] == ([("user", "t0"), ("assistant", "t1"), ("user", "t3"), ("assistant", "t4"), ("user", "end"), ("user", "more")], None, ["/messages/1/content"])


def test_readers_of_several_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    df.write.option("header", True).csv(str(tmp_path / "in/x"))
    df.select("b", "a").write.option("header", True).csv(str(tmp_path / "in/y"))
    got = readers.read_contract_csv(spark, str(tmp_path / "in/*"), ["a", "b"], "a int, b double")
    assert got.collect() == df.select(F.col("a"), F.col("b")).collect()
