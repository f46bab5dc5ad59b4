"""Relational joins of decision data: lagged, interval, overlap, precedence, theta, isolation and alignment joins."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.components import connected_components
from decisa.operators.ranks import in_ranges
from decisa.session import materialize

#: Windows (30 bytes each) up to this number are broadcast.
BROADCAST_ROWS = 100_000


def lagged_join(left: DataFrame, right: DataFrame, by: list[str], time: str, lag: int, value: str, out: str) -> DataFrame:
    """left with right's value exactly `lag` units later on the shared grid; gaps give no row (not lag(), which skips them)."""
    moved = right.select(*by, (F.col(time) - F.lit(lag)).alias(time), F.col(value).alias(out))
    return left.join(moved, [*by, time])


def calendar_shift(left: DataFrame, right: DataFrame, by: list[str], day: str, days: int, value: str, out: str) -> DataFrame:
    """left with right's value exactly `days` calendar days ahead (negative: behind); gaps give null."""
    moved = right.select(*by, F.date_sub(day, days).alias(day), F.col(value).alias(out))
    return left.join(moved, [*by, day], "left")


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start.cast("double") / width), F.floor(end.cast("double") / width))


def _width(windows: DataFrame) -> float:
    return windows.agg(F.avg(F.col("_end").cast("double") - F.col("_start").cast("double"))).first()[0] or 1.0


def interval_join(rows: DataFrame, windows: DataFrame, time: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """rows with the half-open window [start, end) that holds their time; unmatched rows stay with nulls. Up to
    BROADCAST_ROWS windows (folds, regimes) are broadcast; more meet the rows in buckets of a mean window's length, for
    which times are numbers or timestamps."""
    w = windows.select(*keep, F.col(start).alias("_start"), F.col(end).alias("_end"))
    inside = (F.col(time) >= F.col("_start")) & (F.col(time) < F.col("_end"))
    if w.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(w), inside, "left").drop("_start", "_end")
    width = _width(w)
    w = w.filter("_start < _end").withColumn("_bucket", F.explode(_buckets(F.col("_start"), F.col("_end"), width)))
    rows = rows.withColumn("_at", F.floor(F.col(time).cast("double") / width))
    return rows.join(w, (F.col("_at") == F.col("_bucket")) & inside, "left").drop("_start", "_end", "_at", "_bucket")


def overlap_reasons(rows: DataFrame, windows: DataFrame, start: str, end: str, w_start: str, w_end: str, name: str) -> DataFrame:
    """rows with the sorted names of all windows that [start, end] overlaps; touching a window's start counts. Up to
    BROADCAST_ROWS windows are one broadcast array; more meet the rows in buckets, as in interval_join()."""
    w = windows.select(F.col(name).alias("_name"), F.col(w_start).alias("_start"), F.col(w_end).alias("_end"))
    if w.count() <= BROADCAST_ROWS:
        all_ = w.agg(F.collect_list(F.struct("_name", "_start", "_end")).alias("_w"))
        hit = F.filter("_w", lambda x: (F.col(start) < x["_end"]) & (F.col(end) >= x["_start"]))
        return rows.join(F.broadcast(all_)).withColumn("reasons", F.array_sort(F.transform(hit, lambda x: x["_name"]))).drop("_w")
    width = _width(w)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "overlapped")
    spans = rows.filter(F.col(start) <= F.col(end)).select("_row", F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(_buckets(F.col(start), F.col(end), width)).alias("_bucket"))
    w = w.withColumn("_bucket", F.explode(_buckets(F.col("_start"), F.col("_end"), width)))
    hits = spans.join(w, "_bucket").filter((F.col("_s") < F.col("_end")) & (F.col("_e") >= F.col("_start"))).select("_row", "_name", "_start", "_end").distinct()
    named = hits.groupBy("_row").agg(F.array_sort(F.collect_list("_name")).alias("reasons"))
    empty = F.array().cast(dict(named.dtypes)["reasons"])
    return rows.join(named, "_row", "left").withColumn("reasons", F.coalesce("reasons", empty)).drop("_row")


def precedence_merge(tables: list[DataFrame], keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The union of tables, of each key the row of the first table that has it; `order` decides within a table."""
    parts = [t.withColumn("_priority", F.lit(i)) for i, t in enumerate(tables)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    w = Window.partitionBy(*keys).orderBy("_priority", *(order or []))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_priority")


def cohort_intersection(left: DataFrame, right: DataFrame, key: str, record: str) -> DataFrame:
    """One row: keys that both cohorts have, and the affected records on each side."""
    side = lambda t, n: t.groupBy(key).agg(F.countDistinct(record).alias(n))
    both = side(left, "l").join(side(right, "r"), key)
    return both.agg(F.count("*").alias("shared_keys"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_records"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_records"))


def assert_isolated(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Fail when a fit table and an evaluation table share any value of a key."""
    for key in keys:
        if not left.select(key).join(right.select(key).distinct(), key, "leftsemi").isEmpty():
            raise ValueError(f"both sides share values of {key}")


def matched_pairs(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], left_name: str = "base", right_name: str = "other") -> DataFrame:
    """Full-identity join: every key once on each side, else an error; values come back under both names."""
    a = left.select(*keys, *[F.col(v).alias(f"{left_name}_{v}") for v in values], F.lit(1).alias("_a"))
    b = right.select(*keys, *[F.col(v).alias(f"{right_name}_{v}") for v in values], F.lit(1).alias("_b"))
    both = a.join(b, keys, "full_outer")
    fine = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "the sides differ in their keys")
    return both.filter(fine.isNull()).drop("_a", "_b")


def perturbation_delta(records: DataFrame, probs: str = "probs", key: str = "record_id", base: str = "base_id") -> DataFrame:
    """Each perturbed record against its base: argmax flip, L1 and largest absolute difference over both key sets.
    Argmax ties go to the largest key. Records whose base is missing are left out."""
    top = lambda m: F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))["key"]
    b = records.select(F.col(key).alias("_base"), F.col(probs).alias("_p"))
    both = records.filter(F.col(base).isNotNull()).join(b, F.col(base) == F.col("_base"))
    delta = F.map_values(F.map_zip_with(F.col(probs), F.col("_p"), lambda k, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))))
    return both.select(key, base, (top(F.col(probs)) != top(F.col("_p"))).alias("flipped"), F.aggregate(delta, F.lit(0.0), lambda a, x: a + x).alias("l1"), F.array_max(delta).alias("max_delta"))


def first_echo(units: DataFrame, segments: DataFrame, by: list[str], pos: str = "pos", needle: str = "needle", text: str = "text", strength: str = "strength") -> DataFrame:
    """For each (group, position) with needles: the first later segment of the group that contains one; stronger
    needles win, then earlier segments. The join is on the group; `contains` is its residual."""
    s = segments.select(*by, F.col(pos).alias("echo_pos"), F.col(text).alias("_text"))
    hit = units.join(s, by).filter((F.col("echo_pos") > F.col(pos)) & F.contains(F.col("_text"), F.col(needle)))
    best = F.min_by(F.struct("echo_pos", needle, strength), F.struct(-F.col(strength), F.col("echo_pos"), F.col(needle)))
    return hit.groupBy(*by, pos).agg(best.alias("_b")).select(*by, pos, "_b.*")


def path_links(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths (a row a distinct path) with a shorter path that ends theirs at a slash: its path as suffix, its other
    columns as suffix_*. Each path's own suffixes are exploded, at most its depth, and joined on equality, so paths that
    end in a frequent name don't meet each other. Leading slashes don't count; a suffix has a name."""
    bare = F.ltrim(F.col(path), F.lit("/"))
    names = F.split(F.col(path), "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "/"))
    longer = paths.filter(F.size(names) >= 2).withColumn("_end", F.explode(F.array_distinct(F.transform(ends, lambda e: F.ltrim(e, F.lit("/")))))).filter("_end <> ''")
    shorter = paths.select(bare.alias("_bare"), F.col(path).alias("suffix"), *[F.col(c).alias("suffix_page" if c == "page_id" else f"suffix_{c}") for c in paths.columns if c != path])
    return longer.join(shorter, F.col("_end") == F.col("_bare")).filter(F.col(path) != F.col("suffix")).drop("_end", "_bare")


def donor_join(rows: DataFrame, role: str, group: str, key: str, seed: str) -> DataFrame:
    """Each row with a donor of the same role and another group, the next one round a circle of hashes; null where a
    role has one group.

    Rows are dealt into ranges of (role, seeded hash). In a range a window finds the next row of another group; the
    last run of a range takes it from the ranges after, of which only the first rows of two groups matter. No pair of
    rows is formed, and one task holds a range, or a row a range of the summary."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    cut = in_ranges(rows.withColumn("_h", h), [role], [F.col("_h"), F.col(key)])
    back = Window.partitionBy("_range", role).orderBy(F.desc("_h"), F.desc(key))  # read backwards, a running value costs a row once
    cut = cut.withColumn("_next", F.struct(F.lag(group).over(back).alias("g"), F.lag(key).over(back).alias("k")))
    cut = cut.withColumn("_mark", F.when(F.col("_next.g") != F.col(group), F.col("_next")))
    at = F.struct("_h", key)
    first, second = F.min_by(F.struct(F.col(group).alias("g"), F.col(key).alias("k")), at), F.min_by("_mark", F.when(F.col("_mark").isNotNull(), at))
    summary = cut.groupBy("_range", role).agg(first.alias("a"), second.alias("b")).select("_range", role, *[F.col(f"{x}.{y}").alias(f"{x}{y}") for x in "ab" for y in "gk"])
    types = dict(rows.dtypes)
    after = summary.groupBy(role).applyInPandas(lambda x: _next_groups(x, role), f"_after int, _role {types[role]}, g1 {types[group]}, k1 {types[key]}, k2 {types[key]}")
    found = cut.withColumn("_later", F.last("_mark", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.join(F.broadcast(after), (F.col("_range") == F.col("_after")) & F.col(role).eqNullSafe(F.col("_role")))
    donor = F.coalesce(F.col("_later.k"), F.when(F.col("g1") != F.col(group), F.col("k1")).otherwise(F.col("k2")))
    return found.select(*rows.columns, donor.alias("donor"))


def _next_groups(ranges: pd.DataFrame, role: str) -> pd.DataFrame:
    """For each range of a role, the first row after it round the circle (g1, k1) and the first one of another group (k2)."""
    r = ranges.sort_values("_range").reset_index(drop=True)
    own = [[(g, k) for g, k in pairs if not pd.isna(g)] for pairs in zip(zip(r["ag"], r["ak"], strict=True), zip(r["bg"], r["bk"], strict=True), strict=True)]
    after: list = [None] * len(r)
    ahead: list = []
    for i in [*reversed(range(len(r)))] * 2:  # the second time round knows what lies behind the circle's end
        after[i] = ahead
        firsts = own[i] + ahead
        ahead = firsts[:1] + [x for x in firsts if x[0] != firsts[0][0]][:1] if firsts else []
    pick = lambda n, k: pd.Series([a[n][k] if len(a) > n else None for a in after], dtype="object")
    return pd.DataFrame({"_after": r["_range"], "_role": r[role], "g1": pick(0, 0), "k1": pick(0, 1), "k2": pick(1, 1)})


def vote_summary(votes: DataFrame, item: str, rater: str, label: str, score: str) -> DataFrame:
    """Per item: votes, distinct labels, flips against the first rater by name, and the spread of scores. Votes are
    counted by label first, so an item's votes never meet in one row."""
    by_label = votes.groupBy(item, label).agg(F.count("*").alias("_n"), F.min(rater).alias("_r"), F.max(score).alias("_high"), F.min(score).alias("_low"))
    g = by_label.groupBy(item).agg(
        F.sum("_n").alias("votes"), F.count(label).alias("labels"), F.sum(F.when(F.col(label).isNotNull(), F.col("_n"))).alias("_said"),
        F.min_by(F.when(F.col(label).isNotNull(), F.col("_n")), "_r").alias("_first"), (F.max("_high") - F.min("_low")).alias("spread"),
    )
    return g.withColumn("flips", F.coalesce(F.col("_said") - F.col("_first"), F.lit(0))).drop("_said", "_first")


def label_overlap(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """full_outer join of two raters: status is shared, only_a or only_b, and whether shared labels agree."""
    x = a.select(key, F.col(label).alias("label_a"))
    y = b.select(key, F.col(label).alias("label_b"))
    both = x.join(y, key, "full_outer")
    status = F.when(F.col("label_b").isNull(), "only_a").when(F.col("label_a").isNull(), "only_b").otherwise("shared")
    return both.withColumn("status", status).withColumn("agree", F.when(F.col("status") == "shared", F.col("label_a") == F.col("label_b")))


def align_predictions(rows: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every reference row with its prediction and a status: ok, missing (no prediction) or extra (no reference)."""
    p = rows.select(*keys, F.col(value).alias("predicted"), F.lit(1).alias("_p"))
    r = reference.select(*keys, F.col(value).alias("expected"), F.lit(1).alias("_r"))
    both = r.join(p, keys, "full_outer")
    return both.withColumn("status", F.when(F.col("_p").isNull(), "missing").when(F.col("_r").isNull(), "extra").otherwise("ok")).drop("_p", "_r")


def overlay_labels(rows: DataFrame, labels: DataFrame, key: str, shared: list[str], teacher: list[str]) -> DataFrame:
    """rows with the teacher columns of labels; a label of an unknown row or with a changed shared column is an error."""
    t = labels.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_s_{c}") for c in shared], *teacher)
    if not t.join(rows.select(key), F.col("_k") == F.col(key), "leftanti").isEmpty():
        raise ValueError("labels name rows that don't exist")
    both = rows.join(t, F.col("_k") == F.col(key), "left")
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    both = both.filter(F.assert_true(F.col("_k").isNull() | same, "a label changes a shared column").isNull())
    return both.drop("_k", *[f"_s_{c}" for c in shared])


#: Edges of a group that one task follows by itself at most, and edges of small groups that are followed together.
FOLLOWED_AT_ONCE = 100_000


def closure(edges: DataFrame, seeds: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", group: str = "group", at_once: int = FOLLOWED_AT_ONCE) -> DataFrame:
    """(group, node): what seeds reach along edges within their group, seeds included.

    A group of up to `at_once` edges is followed to its end in one task, so chains cost no rounds; groups are dealt by hash
    to lots of about so many edges, and a lot costs one call. Larger groups go on in
    rounds over all tasks, each a step along the edges, until none adds a node: as many as their longest path has steps."""
    known = materialize(seeds.select(group, node).distinct(), "closure")
    e = materialize(edges.select(group, F.col(src).alias(node), F.col(dst).alias("_to")).distinct(), "closure-edges")
    sizes = e.groupBy(group).agg(F.count("*").alias("_n"))
    small, large = sizes.filter(F.col("_n") <= at_once).select(group), materialize(sizes.filter(F.col("_n") > at_once).select(group), "closure-large")
    types = {f.name: f.dataType.simpleString() for f in known.schema}
    edges_of = sizes.filter(F.col("_n") <= at_once).agg(F.sum("_n")).first()[0] or 0
    lot = F.pmod(F.xxhash64(group), F.lit(max(e.sparkSession.sparkContext.defaultParallelism, -(-edges_of // at_once)))).alias("_lot")

    def follow(edges_: pa.Table, seeds_: pa.Table) -> pa.Table:
        to: dict = {}
        for g, x, y in zip(*(edges_.column(c).to_pylist() for c in (group, node, "_to")), strict=True):
            if x is not None:
                to.setdefault((g, x), []).append(y)
        seen = set(zip(*(seeds_.column(c).to_pylist() for c in (group, node)), strict=True))
        open_ = list(seen)
        while open_:
            at = open_.pop()
            for y in to.get(at, ()):
                if (at[0], y) not in seen:
                    seen.add((at[0], y))
                    open_.append((at[0], y))
        return pa.table({c: pa.array([r[k] for r in seen], seeds_.schema.field(c).type) for k, c in enumerate((group, node))})

    dealt = lambda t: t.join(small, group, "leftsemi").select(lot, "*").groupBy("_lot")
    followed = dealt(e).cogroup(dealt(known)).applyInArrow(follow, f"`{group}` {types[group]}, `{node}` {types[node]}")
    alone = known.join(sizes.select(group), group, "leftanti")
    done = materialize(followed.unionByName(alone), "closure")
    if large.isEmpty():
        return done
    known, e = known.join(large, group, "leftsemi"), e.join(large, group, "leftsemi")
    fresh = known
    while True:
        found = fresh.join(e, [group, node]).select(group, F.col("_to").alias(node)).distinct().join(known, [group, node], "leftanti")
        fresh = materialize(found, "closure")
        if fresh.isEmpty():
            return done.unionByName(known)
        known = materialize(known.unionByName(fresh), "closure")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge table."""
    return connected_components(edges, a, b)
