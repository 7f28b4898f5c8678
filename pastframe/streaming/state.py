"""Arriving maps: running entity state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAST = 10
STATE = "ts timestamp, n long, values array<double>, done_n long, done array<double>, ewm double, done_ewm double"


def running_state(stream: DataFrame, key: str, value: str, order: list[str], span: int = 5) -> DataFrame:
    """key, ts, order columns, value, last_10 mean, count and ewm before each row's timestamp, kept as keyed state.

    Rows of one timestamp don't see each other, in a batch or across batches. Rows
    are taken in time order within a batch; a row older than the state is late: it
    is answered from the state as it is and added to it.
    """
    alpha = 2 / (span + 1)
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, ts timestamp, " + "".join(f"{c} {kinds[c]}, " for c in order) + f"{value} double, last_mean double, n_before long, ewm double"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, n, values, done_n, done, ewm, done_ewm = state.get if state.exists else (None, 0, [], 0, [], None, None)
        values, done = list(values), list(done)
        p = pd.concat([x for x in parts if len(x)]).sort_values(["ts", *order], kind="stable")
        rows = []
        for r in p.itertuples(index=False):
            at = getattr(r, "ts")
            if ts is None or at > ts:
                ts, done_n, done, done_ewm = at, n, list(values), ewm
            known = [x for x in done if x is not None and x == x]
            rows.append((k[0], at, *[getattr(r, c) for c in order], getattr(r, value), sum(known) / len(known) if known else None, done_n, done_ewm))
            x = getattr(r, value)
            x = None if x is None or x != x else float(x)
            n, values = n + 1, [*values, x][-LAST:]
            if x is not None:
                ewm = x if ewm is None else ewm + alpha * (x - ewm)
        state.update((ts.to_pydatetime() if hasattr(ts, "to_pydatetime") else ts, n, values, done_n, done, ewm, done_ewm))
        yield pd.DataFrame(rows, columns=[key, "ts", *order, value, "last_mean", "n_before", "ewm"])

    rows = stream.select(key, "ts", *order, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a streaming frame over what has arrived, batch by batch."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
