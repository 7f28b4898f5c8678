"""Arriving entries: each entity's history before an entry, in event time, as typed state with timers."""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LONG, SHORT = 500, 10  # entries of the long-term and of the recent mean
MANY = 20_000  # rows of a key that a worker holds, besides those of one slot
OUT = ["micros__", "value__", "carried__", "last_mean", "long_term_mean", "n_before", "ewm"]
#: Keys and order columns go through the worker as JSON: pandas would make floats of whole numbers beside a null, and mix such keys up.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class _History(StatefulProcessor):
    """A key's rows wait in one list; a timer answers all of its slots that the watermark has passed, in order.

    State is called a few times a key and micro-batch, not for every slot. Where more than MANY rows of a key wait, they
    are dealt to a map of slots, of which one is held at a time; a row without a time in the list says that there are such.
    """

    def __init__(self, order: list[str], slot: int, alpha: float, ttl: int | None, many: int = MANY):
        self.order, self.slot, self.alpha, self.ttl, self.many = order, slot, alpha, ttl, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, v double, carried string")
        self.slots = handle.getMapState("slots", "slot long", "at array<long>, v array<double>, carried array<string>")
        self.known = handle.getValueState("known", "n long, ewm double, values array<double>", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        plain = lambda x: None if pd.isna(x) else float(x)
        for r in initialState.itertuples(index=False):
            self.known.update((int(r.n), plain(r.ewm), [plain(v) for v in r.values]))

    def _end(self, at: int) -> int:
        return (at // (1000 * self.slot) + 1) * self.slot

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            if len(p):
                self.waiting.appendList([(int(a), None if v != v else v, c) for a, v, c in zip(p.micros__.tolist(), p.value__.astype(float).tolist(), p.carried__.tolist(), strict=True)])
                self.handle.registerTimer(self._end(int(p.micros__.min())))
        return iter(())

    def _deal(self, rows: list[tuple]) -> None:
        by: dict[int, list[tuple]] = {}
        for r in rows:
            by.setdefault(r[0] // (1000 * self.slot), []).append(r)
        for slot, part in by.items():
            new = [list(x) for x in zip(*part, strict=True)]
            if self.slots.containsKey((slot,)):
                new = [list(a) + b for a, b in zip(self.slots.getValue((slot,)), new, strict=True)]
            self.slots.updateValue((slot,), tuple(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows, dealt = [], False
        for at, v, carried in self.waiting.get():
            if at is None:
                dealt = True
                continue
            rows.append((at, v, carried))
            if len(rows) >= self.many:
                self._deal(rows)
                rows, dealt = [], True
        if dealt:
            self._deal(rows)
            rest = []
            for slot in sorted(k[0] for k in self.slots.keys()):
                if (slot + 1) * self.slot <= now:
                    yield self._answered([*zip(*self.slots.getValue((slot,)), strict=True)])
                    self.slots.removeKey((slot,))
                else:
                    rest.append((slot + 1) * self.slot)
            stay = [(None, None, None)] if rest else []
        else:
            due = [r for r in rows if self._end(r[0]) <= now]
            stay = [r for r in rows if self._end(r[0]) > now] if len(due) < len(rows) else []
            rest = [self._end(r[0]) for r in stay]
            if due:
                yield self._answered(due)
        if stay:
            self.waiting.put(stay)
            self.handle.registerTimer(min(rest))
        else:
            self.waiting.clear()

    def _answered(self, rows: list[tuple]) -> pd.DataFrame:
        """The rows in order with what was known before each, which then knows them too."""
        ranks = [[(x is not None, x) for x in map(json.loads(c).get, self.order)] for _, _, c in rows]
        rows = [r[0] for r in sorted(zip(rows, ranks, strict=True), key=lambda r: (r[0][0], r[1]))]
        got = self.known.get() if self.known.exists() else None
        n, ewm, last = (got[0], got[1], deque(got[2], LONG)) if got is not None else (0, None, deque(maxlen=LONG))
        out, at, seen = [], None, ()
        for r in rows:
            if r[0] != at:  # rows of one time don't see each other
                known = [x for x in last if x is not None]
                recent = [x for x in list(last)[-SHORT:] if x is not None]
                seen = (math.fsum(recent) / len(recent) if recent else None, math.fsum(known) / len(known) if known else None, n, ewm)
                at = r[0]
            out.append((*r, *seen))
            n += 1
            last.append(r[1])
            if r[1] is not None:
                ewm = r[1] if ewm is None else ewm + self.alpha * (r[1] - ewm)
        self.known.update((n, ewm, list(last)))
        return pd.DataFrame(out, columns=OUT)


def state_of(entries: DataFrame, key: str, value: str, order: list[str], span: int = 5) -> DataFrame:
    """What ``history_before`` would know after the batch table ``entries``: key, n, values, ewm. Nulls count in n alone.

    Of each key only the last LONG entries and the weights of all are read, by windows; the
    mean with weights (1 - alpha)^age starts at the first value.
    """
    alpha = 2 / (span + 1)

    v = F.col(value).cast("double")
    back = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in ["ts", *order]])
    aged = entries.where(F.col(key).isNotNull()).select(key, v.alias("v"), F.row_number().over(back).alias("i"), F.count(v).over(back).alias("age"), F.count(v).over(Window.partitionBy(key)).alias("known"))
    weight = F.pow(F.lit(1 - alpha), F.col("age") - 1) * F.when(F.col("age") == F.col("known"), 1.0).otherwise(alpha)
    got = aged.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("v").isNotNull(), weight * F.col("v"))).alias("ewm"),
        F.sort_array(F.collect_list(F.when(F.col("i") <= LONG, F.struct((-F.col("i")).alias("i"), "v")))).alias("l"),
    )
    return got.select(key, "n", F.transform("l", lambda x: x.v).alias("values"), "ewm")


def history_before(
    stream: DataFrame, key: str, value: str, order: list[str], slot: str = "1 hour", delay: str = "1 hour", span: int = 5, known: DataFrame | None = None, ttl: int | None = None
) -> DataFrame:
    """key, ts, order columns, value; and of the key's entries before ts: last_mean (10), long_term_mean (500), n_before, ewm.

    Entries are answered in event time, whatever order and batches they come in, once the
    watermark (``delay`` behind the newest time) has passed the end of their ``slot``; later
    ones than that are late and not answered. Entries of one timestamp don't see each other. A batch of a
    key is read frame by frame; memory holds MANY entries or one slot of one key, and its last 500 values.
    ``known`` hands over a batch table's state (``state_of``); ``ttl`` in milliseconds lets
    keys that stay away be forgotten. Null keys are one key, null times are no entries.
    The session needs the RocksDB state store (STORE).
    """
    ms = int(pd.Timedelta(slot) / pd.Timedelta("1ms"))
    carried = list(dict.fromkeys([key, *order]))
    kinds = ", ".join(f"`{c}` {t}" for c, t in stream.select(*carried).dtypes)
    name = F.to_json(F.struct(key)).alias("key__")
    rows = stream.where("ts is not null").withWatermark("ts", delay)
    rows = rows.select(name, "ts", F.unix_micros("ts").alias("micros__"), F.col(value).cast("double").alias("value__"), F.to_json(F.struct(*carried), JSON).alias("carried__"))
    got = rows.groupBy("key__").transformWithStateInPandas(
        _History(order, ms, 2 / (span + 1), ttl), f"{OUT[0]} long, {OUT[1]} double, {OUT[2]} string, last_mean double, long_term_mean double, n_before long, ewm double",
        "Append", "EventTime", known.select(name, "n", "values", "ewm").groupBy("key__") if known is not None else None,
    )
    back = F.from_json("carried__", kinds, JSON)
    return got.select(*[back[c].alias(c) for c in carried], F.timestamp_micros("micros__").alias("ts"), F.col("value__").alias(value), "last_mean", "long_term_mean", "n_before", "ewm")
