"""Scorers that run on Spark: a model built once a worker answers whole requests in Arrow batches, under a contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisa.operators.requests import score_reason

ANSWERS = "map<string, map<string, double>>"
#: From the ids and texts of one request's candidates to an answer for each id: a map of label to probability.
Scorer = Callable[[list[str], list[str]], dict[str, dict[str, float]]]


def text_features(texts: list[str]) -> np.ndarray:
    """A row a text: one, the logarithm of its length plus one, the shares of digits and of question marks."""
    size = np.array([len(t) for t in texts], float)
    share = lambda of: np.array([sum(map(t.count, of)) for t in texts], float) / np.maximum(size, 1)
    return np.column_stack([np.ones(len(texts)), np.log1p(size), share("0123456789"), share("?")])


def logistic_scorer(weights: list[float]) -> Callable[[], Scorer]:
    """A factory of scorers by logistic weights of text_features(), as a fit of the library gives them."""

    def build() -> Scorer:
        w = np.asarray(weights, float)

        def score(ids: list[str], texts: list[str]) -> dict[str, dict[str, float]]:
            p = 1 / (1 + np.exp(-(text_features(texts) @ w)))
            return {i: {"false": 1 - x, "true": x} for i, x in zip(ids, p.tolist(), strict=True)}

        return score

    return build


def answered(candidates: DataFrame, key: str, id_: str, text: str, build: Callable[[], Scorer], tolerance: float = 1e-6) -> DataFrame:
    """(key, reason, scores): a scorer's answer for the candidates of each request, scores being (id, p) of "true".

    build is called once for each task of Python workers, not once a batch. An answer that breaks the contract of
    requests.score_reason(), or an error of the scorer (scorer_error), gives its request that reason and no scores; other
    requests of the batch keep theirs. Null texts are empty. Candidates of one request, which is one row here, are few."""
    one = F.struct(F.col(id_).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = candidates.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("_c"))
    rows = rows.select(key, F.transform("_c", lambda c: c["id"]).alias("_ids"), F.transform("_c", lambda c: c["text"]).alias("_texts"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = build()
        for ids, texts in batches:
            out: list[dict | None] = []
            for some, said in zip(ids, texts, strict=True):
                try:
                    out.append(score(list(some), list(said)))
                except Exception:  # a scorer's own fault must not take other requests with it
                    out.append(None)
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    rows = rows.withColumn("_answers", F.pandas_udf(run, ANSWERS)("_ids", "_texts"))
    reason = F.when(F.col("_answers").isNull(), "scorer_error").otherwise(score_reason(F.col("_ids"), F.col("_answers"), tolerance))
    rows = rows.withColumn("reason", reason)
    scores = F.transform("_ids", lambda i: F.struct(i.alias("id"), F.col("_answers")[i]["true"].alias("p")))
    return rows.select(key, "reason", F.when(F.col("reason").isNull(), scores).otherwise(F.array().cast("array<struct<id: string, p: double>>")).alias("scores"))
