"""Validators: each row gets the first reason it fails, in declared order, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is not true (null counts as not true), else null."""
    out = F.when(F.lit(False), F.lit(""))
    for name, ok in rules:
        out = out.when(~F.coalesce(ok, F.lit(False)), name)
    return out


def pit_reason(features: str = "features", label: str = "label", decision: str = "decision_ns", universe: str = "universe_available_ns") -> Column:
    """A point-in-time record: event <= available <= decision, fit cutoff <= available, decision < label end <= label
    available, universe known by the decision, values finite."""
    f = F.map_values(features)
    each = lambda test: F.forall(f, lambda x: F.coalesce(test(x), F.lit(False)))
    d = F.col(decision)
    return first_reason([
        ("decision_negative", d >= 0),
        ("universe_late", F.col(universe) <= d),
        ("no_features", F.size(features) > 0),
        ("value_not_finite", each(lambda x: ~F.isnan(x["value"]) & (F.abs(x["value"]) < float("inf")))),
        ("event_after_available", each(lambda x: x["event_ns"] <= x["available_ns"])),
        ("available_after_decision", each(lambda x: x["available_ns"] <= d)),
        ("fit_after_available", each(lambda x: x["fit_cutoff_ns"] <= x["available_ns"])),
        ("label_ends_early", F.col(f"{label}.end_ns") > d),
        ("label_available_early", F.col(f"{label}.available_ns") >= F.col(f"{label}.end_ns")),
    ])


def cohort_faults(df: DataFrame, id_col: str, snapshot: list[str], features: str | None = None) -> DataFrame:
    """(fault, n): repeated ids, repeated snapshots, and rows whose feature names differ from the most common ones."""
    dup = lambda cols, name: df.groupBy(*cols).agg(F.count("*").alias("k")).filter("k > 1").agg(F.lit(name).alias("fault"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    out = dup([id_col], "repeated_id").unionByName(dup(snapshot, "repeated_snapshot"))
    if features:
        names = df.groupBy(F.array_sort(F.map_keys(features)).alias("names")).agg(F.count("*").alias("k"))
        out = out.unionByName(names.agg(F.lit("feature_drift").alias("fault"), (F.sum("k") - F.max("k")).alias("n")))
    return out


def check_folds(folds: list[tuple[str, int, int]], as_of: int | None = None, embargo: int = 0) -> None:
    """Half-open windows in order, disjoint, and the last one's end no later than as_of."""
    for (a, s, e), nxt in zip(folds, [*folds[1:], None], strict=True):
        if s >= e:
            raise ValueError(f"{a} is empty")
        if nxt and e + embargo > nxt[1]:
            raise ValueError(f"{a} reaches into {nxt[0]}")
    if as_of is not None and folds[-1][2] > as_of:
        raise ValueError("the last window ends after as_of")


def distribution_reason(probs: str, gold: str | None = None, tolerance: float = 1e-8) -> Column:
    """A target distribution: not empty, all in [0, 1], sums to 1; a one-hot gold label among its keys."""
    v = F.map_values(probs)
    rules = [
        ("empty", F.size(v) > 0),
        ("out_of_range", F.forall(v, lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False)))),
        ("sum", F.abs(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) - 1) <= tolerance),
    ]
    if gold:
        rules.append(("unknown_gold", F.array_contains(F.map_keys(probs), F.col(gold))))
    return first_reason(rules)


def question_reason(kind: str, criteria: str) -> Column:
    """boolean: no criteria or two; choice: 2 to 255; score: 2 to 10; criteria texts not blank."""
    n = F.coalesce(F.size(criteria), F.lit(0))
    k = F.col(kind)
    size = F.when(k == "boolean", n.isin(0, 2)).when(k == "choice", n.between(2, 255)).when(k == "score", n.between(2, 10))
    return first_reason([("unknown_type", k.isin("boolean", "choice", "score")), ("criteria_count", size), ("blank_criterion", F.forall(F.coalesce(criteria, F.array().cast("array<string>")), lambda c: F.length(F.trim(c)) > 0))])


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def tool_link_reason(df: DataFrame, by: list[str], pos: str, kind: str, call_id: str) -> DataFrame:
    """(by, reason): repeated call ids, results without an earlier call, calls never answered; null when all is well."""
    g = df.groupBy(*by, call_id).agg(
        F.count_if(F.col(kind) == "call").alias("calls"), F.count_if(F.col(kind) == "result").alias("results"),
        F.min(F.when(F.col(kind) == "call", F.col(pos))).alias("_c"), F.min(F.when(F.col(kind) == "result", F.col(pos))).alias("_r"),
    )
    fault = F.when(F.col("calls") > 1, "repeated_call").when((F.col("results") > 0) & (F.col("_c").isNull() | (F.col("_r") < F.col("_c"))), "orphan_result").when(F.col("results") > 1, "repeated_result").when(F.col("results") == 0, "pending_call")
    return g.withColumn("_f", fault).groupBy(*by).agg(F.min("_f").alias("reason"))


def protection(df: DataFrame, structural: str, flagged: str, eligible: str) -> DataFrame:
    """df with policy: structure before the caller's flag before ineligibility; a null anywhere protects."""
    p = F.when(F.coalesce(F.col(structural), F.lit(True)), "structure").when(F.coalesce(F.col(flagged), F.lit(True)), "flagged").when(~F.coalesce(F.col(eligible), F.lit(False)), "not_eligible").otherwise("droppable")
    return df.withColumn("policy", p)
