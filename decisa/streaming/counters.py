"""Sliding counters as a stream: the state of a key is its rows of one window, and a timer lets rows go."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "seconds array<long>, ids array<long>, amounts array<double>, told array<boolean>"


def stream_counters(events: DataFrame, key: str, id_: str, ts: str, value: str, span: int, late: str = "1 minute") -> DataFrame:
    """(key, id, second, orders, turnover, held) for each row of a stream: the rows of its key in (second - span, second],
    and the sum of their absolute values, as windows.rolling_counters() counts them.

    A row is told when the watermark, `late` behind the newest row of all keys, has passed its second, so rows may come in
    any order within it; those that come later still are dropped. Then a key keeps only rows of the last span seconds
    before the watermark and untold ones: held says how many, which is bounded by what falls into span and `late`
    together. A key without new rows is told, and forgotten, by its timer. Null values count as 0."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    types = dict(events.dtypes)
    rows = events.select(F.col(key), F.col(id_).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.abs(F.coalesce(F.col(value), F.lit(0))).cast("double").alias("amount"))
    rows = rows.withWatermark("ts", late).withColumn("second", F.unix_seconds("ts"))

    def run(of, frames, state):
        known = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        table = pd.DataFrame(dict(zip(("second", "id", "amount", "told"), known, strict=True)))
        if not state.hasTimedOut:
            new = pd.concat(list(frames))[["second", "id", "amount"]].assign(told=False)
            table = new if table.empty else pd.concat([table, new])
        passed = state.getCurrentWatermarkMs() // 1000
        table = table.sort_values(["second", "id"], kind="stable")
        kept = int(((table["second"] >= passed) | (table["second"] > passed - 1 - span)).sum())
        seconds, upto = table["second"].to_numpy(), table["amount"].cumsum().to_numpy()
        out = []
        for k, (second, id_, told) in enumerate(zip(seconds.tolist(), table["id"].tolist(), table["told"].tolist(), strict=True)):
            if told or second >= passed:
                continue
            low, high = seconds.searchsorted(second - span, "right"), seconds.searchsorted(second, "right")
            out.append((*of, int(id_), int(second), int(high - low), float(upto[high - 1] - (upto[low - 1] if low else 0.0)), kept))
        table = table.assign(told=table["second"] < passed)
        table = table[~table["told"] | (table["second"] > passed - 1 - span)]
        if table.empty:
            if state.exists:
                state.remove()
        else:
            state.update((table["second"].astype(int).tolist(), table["id"].astype(int).tolist(), table["amount"].astype(float).tolist(), table["told"].astype(bool).tolist()))
            waiting = table.loc[~table["told"], "second"]
            due = int(waiting.min()) + 1 if len(waiting) else int(table["second"].max()) + span + 1
            state.setTimeoutTimestamp(due * 1000 - 1)  # a timer goes off once the watermark is beyond it
        yield pd.DataFrame(out, columns=[key, "id", "second", "orders", "turnover", "held"])

    schema = f"{key} {types[key]}, id long, second long, orders long, turnover double, held long"
    return rows.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
