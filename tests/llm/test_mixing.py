import random
from collections import defaultdict

from decisa.llm import mixing


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, target, capped = 1.5 * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = capped | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        capped |= {s: 2.0 * sizes[s] for s in over}


def rows(seed=1):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * rng.randrange(1, 60)), "big") for i in range(400)]
    out += [(400 + i, "\t".join(["w"] * rng.randrange(1, 60)) + " ", rng.choice(["s1", "s2", "\u00e9", None])) for i in range(300)]
    return out + [(1000, None, "s1"), (1001, "", "s1"), (1002, " \n", None), (None, "a b", "s2"), (5, "w w", "big"), (1003, None, "only-empty")]


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(data)
    sizes, taken = defaultdict(int), defaultdict(int)
    by_source = {}
    for i, t, s in data:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    lookup = defaultdict(list)
    for i, t, s in data:
        lookup[(i, len((t or "").split()))].append(s)
    for r in got:
        s = lookup[(r["doc_id"], r["size"])].pop() if len(set(lookup[(r["doc_id"], r["size"])])) == 1 else None
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by_source.setdefault(s, (r["source_size"], r["target"]))
        taken[s] += r["taken"]
    for s, size in sizes.items():
        if s in by_source:
            assert by_source[s][0] == size and abs(by_source[s][1] - want[s]) < 1e-6
            assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_documents_are_repeated(spark):
    data = [(*r, i, -i, [i]) for i, r in enumerate(rows())]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, _key int, _hash int, _plan array<int>")
    mixed = mixing.mixed_documents(df)
    assert mixed.dtypes == df.dtypes
    assert {tuple(map(str, r)) for r in mixed.collect()} <= {tuple(map(str, r)) for r in data}
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert words == mixing.mix_sources(df).agg({"taken": "sum"}).first()[0]


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
