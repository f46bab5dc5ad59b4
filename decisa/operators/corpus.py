"""Corpus curation: deduplication, decontamination, leakage audits, splits, pairs and tool-history cleaning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decisa.operators.ranks import numbered
from decisa.session import materialize


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Of each key the first row in order; sources with priority put it first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_ids(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Exact dedup without moving texts: (key, smallest id, copies), pre-aggregated."""
    return df.groupBy(key.alias("key")).agg(F.min(id_col).alias("kept"), F.count("*").alias("copies"))


def keep_first_of_either(df: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Sequential either-key dedup: walking rows in order, a row goes when either of its keys was seen on a kept row.

    In rounds over the whole table: a row that comes first among the rows left of both its keys stays, and the rows
    that share a key with one that stays go. A round decides at least the first row of each connected group, and all
    rows of a key at once when one of them stays. Null keys are equal to nothing; equal rows are told apart."""
    rows = materialize(df.withColumn("_id", F.monotonically_increasing_id()), "either-rows")
    left = rows.select(F.struct(F.col(order), "_id").alias("_at"), F.col(first).alias("_a"), F.col(second).alias("_b"))
    kept = []
    while True:
        leads = left
        for key in ("_a", "_b"):
            low = left.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("_at").alias("_low"))
            leads = leads.join(low, leads[key] == low["_k"], "left").filter(F.col("_low").isNull() | (F.col("_low") == F.col("_at"))).drop("_k", "_low")
        leads = materialize(leads, "either-kept")
        kept.append(leads.select("_at._id"))
        for key in ("_a", "_b"):
            seen = leads.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
            left = left.join(seen, left[key] == seen["_k"], "leftanti")
        left = materialize(left.join(leads.select(F.col("_at._id").alias("_done")), F.col("_at._id") == F.col("_done"), "leftanti"), "either-left")
        if left.isEmpty():
            break
    ids = kept[0]
    for more in kept[1:]:
        ids = ids.unionByName(more)
    return rows.join(ids, "_id", "leftsemi").drop("_id")


def decontaminate(df: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is in the frozen table's column of that name."""
    for key in keys:
        df = df.join(frozen.select(key).filter(F.col(key).isNotNull()).distinct(), key, "leftanti")
    return df


def leakage_audit(df: DataFrame, key: str, split: str, target: str) -> DataFrame:
    """Keys in more than one split: their splits, rows and whether targets conflict."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.countDistinct(target).alias("targets"), F.count("*").alias("rows"))
    return g.filter(F.size("splits") > 1).select(key, "splits", "rows", (F.col("targets") > 1).alias("conflict"))


def label_conflicts(df: DataFrame, split: str, state: Column, label: str) -> DataFrame:
    """Per split and state (digits as <N>): groups whose rows disagree on the label."""
    g = df.groupBy(split, F.sha2(F.regexp_replace(state, r"\d+", "<N>"), 256).alias("state")).agg(F.count("*").alias("rows"), F.countDistinct(label).alias("labels"))
    return g.filter("labels > 1")


def entity_cut(df: DataFrame, key: str, parts: int = 3) -> DataFrame:
    """Distinct entities in the order of (sha256, key), cut into near-equal groups; the first ones take the rest."""
    e = numbered(df.select(key).distinct(), [], [F.sha2(F.col(key).cast("string"), 256), F.col(key)], "_k")
    n, k = e.count(), F.col("_k") - 1
    base, extra = divmod(n, parts)
    cut = extra * (base + 1)
    group = F.when(k < cut, F.floor(k / (base + 1))).otherwise(extra + F.floor((k - cut) / max(1, base))).cast("int")
    return e.withColumn("part", group).drop("_k")


def verified_repeats(df: DataFrame, by: list[str], same: list[str], order: str) -> DataFrame:
    """df with dropped: a later row that equals an earlier one of its group byte for byte."""
    w = Window.partitionBy(*by, *[F.col(c) for c in same]).orderBy(order)
    return df.withColumn("dropped", F.row_number().over(w) > 1)


def eligible(df: DataFrame, by: list[str], pos: str, role: str) -> DataFrame:
    """df with eligible: assistant turns, and user turns before their conversation's last user turn."""
    last = F.max(F.when(F.col(role) == "user", F.col(pos))).over(Window.partitionBy(*by))
    return df.withColumn("eligible", (F.col(role) == "assistant") | ((F.col(role) == "user") & (F.col(pos) < last)))


def fifo_pairs(df: DataFrame, by: list[str], pos: str, kind: str, opens: str, closes: str) -> DataFrame:
    """(by, open_pos, close_pos): the k-th close pairs with the k-th open, but a close with no open pending is skipped.

    A close is matched when the running opens exceed the matched closes; with balance = opens - closes and its running
    minimum below zero, the matched closes are closes + min(0, minimum), so windows alone decide it."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.filter(F.col(kind).isin(opens, closes)).withColumn("_o", (F.col(kind) == opens).cast("int"))
    rows = rows.withColumn("_bal", F.sum(F.when(F.col("_o") == 1, 1).otherwise(-1)).over(w))
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_bal").over(w)))
    before = F.coalesce(F.lag("_low").over(Window.partitionBy(*by).orderBy(pos)), F.lit(0))
    rows = rows.withColumn("_skip", (F.col("_o") == 0) & (F.col("_low") < before))
    rows = rows.withColumn("_k", F.when(F.col("_o") == 1, F.sum("_o").over(w)).when(~F.col("_skip"), F.sum(F.when((F.col("_o") == 0) & ~F.col("_skip"), 1).otherwise(0)).over(w)))
    o = rows.filter("_o = 1").select(*by, "_k", F.col(pos).alias("open_pos"))
    c = rows.filter("_o = 0 and not _skip").select(*by, "_k", F.col(pos).alias("close_pos"))
    return o.join(c, [*by, "_k"]).drop("_k")


def assign_pairs(df: DataFrame, key: str, anchor: str, label: str) -> DataFrame:
    """Keys that carry both labels under two anchors or more: (key, positives, negatives, anchors)."""
    g = df.groupBy(key).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.countDistinct(anchor).alias("anchors"))
    return g.filter("positives > 0 and negatives > 0 and anchors > 1")


def rare_terms(df: DataFrame, doc: str, terms: str, most: int = 3, low: int = 8, high: int = 40) -> DataFrame:
    """(doc, term, df): terms of 8 to 40 characters that at most `most` documents hold."""
    t = df.select(doc, F.explode(F.array_distinct(terms)).alias("term")).filter(F.length("term").between(low, high))
    n = t.groupBy("term").agg(F.countDistinct(doc).alias("df")).filter(F.col("df") <= most)
    return t.join(n, "term").select(doc, "term", "df").distinct()


def nearest_window(df: DataFrame, by: list[str], pos: str, cost: str, anchor: str, budget: int) -> DataFrame:
    """Greedy with skips: the anchor rows, then rows by distance from the nearest anchor (earlier first), each kept
    if the budget still holds it. A conversation is one task's group; its rows are walked as an array fold."""
    w = Window.partitionBy(*by)
    near = F.array_min(F.transform(F.collect_list(F.when(F.col(anchor), F.col(pos))).over(w), lambda a: F.abs(F.col(pos) - a)))
    rows = df.withColumn("_d", F.when(F.col(anchor), F.lit(-1)).otherwise(F.coalesce(near, F.col(pos))))
    seq = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_d", pos, cost, anchor))).alias("_s"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    fits = lambda a, x: x[anchor] | (a["used"] + x[cost] <= budget)
    fold = F.aggregate("_s", start, lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x[cost]).cast("long").alias("used"), F.concat(a["kept"], F.array(x[pos].cast("bigint"))).alias("kept"))).otherwise(a))
    return seq.select(*by, fold.alias("_f")).select(*by, F.col("_f.used").alias("used"), F.array_sort("_f.kept").alias("kept"))


def drop_oldest(df: DataFrame, by: list[str], pos: str, cost: str, protected: str, budget: int) -> DataFrame:
    """df with kept and overflow: the oldest unprotected rows go until the rest fits; overflow when protected rows alone don't."""
    w = Window.partitionBy(*by)
    later = w.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    free = F.when(F.col(protected), 0).otherwise(F.col(cost))
    floor = F.sum(F.when(F.col(protected), F.col(cost)).otherwise(0)).over(w)
    # removing oldest first keeps exactly the newest free rows whose running cost fits beside the protected ones
    kept = F.col(protected) | (F.sum(free).over(later) + floor <= budget)
    return df.withColumns({"kept": kept, "overflow": floor > budget})


def spaced(df: DataFrame, by: list[str], time: str, gap: int) -> DataFrame:
    """Greedy: a time is kept if it lies at least `gap` after the last kept one; one pass over each group's sorted times."""
    rows = df.select(*by, F.col(time).cast("long").alias(time)).dropna(subset=[time])

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        kept, last = [], None
        for t in pdf[time].tolist():
            kept.append(last is None or t - last >= gap)
            last = t if kept[-1] else last
        return pdf[kept]

    return rows.groupBy(*by).applyInPandas(keep, rows.schema)


def two_pass_pairs(df: DataFrame, id_: str, label: str, near: list[str], far: list[str]) -> DataFrame:
    """(positive, negative, passed): records with label 1 paired with records with label 0, each in one pair at most.

    First the k-th positive and the k-th negative of a group of equal `near` columns are a pair, in the order of ids; what
    is left over there is paired in the same way within equal `far` columns (passed 2), and what is left then stays
    alone. Nulls are equal to each other. Places come from ranges, so a large group is no single task, and a pair is met
    by its place, so no two records are compared. Ids are unique and not null; other labels are left out."""
    rows = df.select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_label"), *dict.fromkeys([*near, *far])).filter("_label in (0, 1)")
    out = None
    for number, by in ((1, near), (2, far)):
        placed = materialize(numbered(rows, [*by, "_label"], [F.col("_id")], "_k"), "pairs")
        both = placed.groupBy("_k", *by).agg(F.max(F.when(F.col("_label") == 1, F.col("_id"))).alias("positive"), F.max(F.when(F.col("_label") == 0, F.col("_id"))).alias("negative"))
        both = materialize(both, "pairs")
        met = both.filter("positive is not null and negative is not null").select("positive", "negative", F.lit(number).alias("passed"))
        out = met if out is None else out.unionByName(met)
        left = both.filter("positive is null or negative is null").select(F.coalesce("positive", "negative").alias("_id"))
        rows = rows.join(left, "_id", "leftsemi")
    return out


# Roles of open corpora as those of requests.
ROLES = {"human": "user", "gpt": "assistant", "system": "system", "user": "user", "assistant": "assistant", "tool": "tool", "function": "tool"}
#: Messages that a history must have, and those at its end that stay.
LEAST_HISTORY, KEPT_TAIL = 5, 3


def open_histories(df: DataFrame, key: str, pos: str, role: str, text: str) -> DataFrame:
    """(key, messages, reference, eligible): conversations of an open corpus as requests with their answer split off.

    Roles are mapped by ROLES; messages of other roles, and blank ones, go. An assistant's last message is the reference,
    null where there is none. What is left must have LEAST_HISTORY messages, end with a user or a tool, and have an
    assistant or a tool before its last KEPT_TAIL; else the conversation is left out. messages: array of (role, content);
    eligible: the pointers of those before the tail that an assistant or a tool said."""
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = df.select(key, pos, F.col(text).alias("content"), F.try_element_at(known, F.col(role)).alias("role")).filter("role is not null and content rlike '\\\\S'")
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, "role", "content"))).alias("m"))
    g = g.withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    answer = (F.size("m") >= 2) & (F.element_at("m", -1)["role"] == "assistant")
    g = g.select(key, F.when(answer, F.element_at("m", -1)["content"]).alias("reference"), F.when(answer, F.slice("m", F.lit(1), F.size("m") - 1)).otherwise(F.col("m")).alias("messages"))
    said = lambda m: m["role"].isin("assistant", "tool")
    eligible = F.filter(F.transform("messages", lambda m, i: F.when((i < F.size("messages") - KEPT_TAIL) & said(m), F.concat(F.lit("/messages/"), i, F.lit("/content")))), lambda p: p.isNotNull())
    g = g.filter(F.size("messages") >= LEAST_HISTORY).withColumn("eligible", eligible)
    return g.filter(F.element_at("messages", -1)["role"].isin("user", "tool") & (F.size("eligible") > 0)).select(key, "messages", "reference", "eligible")
