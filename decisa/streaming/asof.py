"""The backward as-of join as a stateful stream: each key's state is the last settled value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

STATE = "settled_at long, value double"


def stream_asof(rows: DataFrame, key: str = "key", time: str = "t", kind: str = "kind", value: str = "value", horizon: int | None = None) -> DataFrame:
    """(key, t, value, age) for every row of kind `ask`: the value of the key's latest `fact` at or before it, null
    before the first one, or after `horizon` without one.

    A micro-batch's rows are walked in order of (t, facts first); its rows must not be older than those of the batches
    before, as a replay in time order gives them, so one state row a key is all that is kept. A fact that comes late is
    used for later asks only if it is newer than what is known."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    types = dict(rows.dtypes)
    rows = rows.select(key, time, kind, value)

    def run(of, frames, state):
        at, now = state.get if state.exists else (None, None)
        frame = pd.concat(list(frames))
        frame = frame.assign(_ask=frame[kind] != "fact").sort_values([time, "_ask"], kind="stable")
        out = []
        for t, ask, v in frame[[time, "_ask", value]].itertuples(index=False, name=None):
            if not ask:
                if at is None or t >= at:
                    at, now = int(t), None if pd.isna(v) else float(v)
                continue
            known = at is not None and at <= t and (horizon is None or t - at <= horizon)
            out.append((*of, t, now if known else None, t - at if known else None))
        if at is not None:
            state.update((at, now))
        yield pd.DataFrame(out, columns=[key, time, "value", "age"]).astype({"value": "Float64", "age": "Int64"})

    schema = f"{key} {types[key]}, {time} {types[time]}, value double, age long"
    return rows.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
