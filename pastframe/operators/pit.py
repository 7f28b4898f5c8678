"""Point-in-time windows: every feature sees only entries strictly before its own timestamp."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scan import in_order

TS, ORDER = "ts", ("match_id", "map")
DAY = 86_400
HISTORY = 500  # entries that a player's state keeps


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rows_before(keys: list[str], n: int | None, ts: str = TS, order: tuple[str, ...] = ORDER) -> Window:
    """The last n entries of the key (all if None) before the row."""
    return Window.partitionBy(*keys).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def batch(keys: list[str], ts: str = TS, order: tuple[str, ...] = ORDER) -> Window:
    return Window.partitionBy(*keys, ts).orderBy(*order)


def barrier(df: DataFrame, keys: list[str], features: dict[str, tuple[Column, int | None]], ts: str = TS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add aggregates of the last n entries before each row's timestamp.

    ``features``: name to (aggregate, n). The frame is taken by rows, then every
    row of one (key, timestamp) takes the value of the batch's first row, which no
    entry of the batch can reach. One exchange and one sort serve all of them.
    """
    raw = df.withColumns({f"_{name}": agg.over(rows_before(keys, n, ts, order)) for name, (agg, n) in features.items()})
    first = batch(keys, ts, order)
    return raw.withColumns({name: F.first(f"_{name}").over(first) for name in features}).drop(*[f"_{name}" for name in features])


def values_in(c: str) -> Column:
    """The non-null values of the frame, oldest first."""
    return F.collect_list(c)


def slope_of(values: Column) -> Column:
    """Least-squares slope of an array over 0, 1, ...; 0 for fewer than two values."""
    n = F.size(values).cast("double")
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    sy = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    sxy = F.aggregate(F.transform(values, lambda x, i: x * i.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.when(n < 2, 0.0).otherwise((n * sxy - sx * sy) / F.when(n >= 2, n * sxx - sx * sx))


def distinct_before(df: DataFrame, keys: list[str], what: str, name: str, ts: str = TS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """How many distinct ``what`` the key had before the timestamp: a running sum of first appearances."""
    seen = Window.partitionBy(*keys, what).orderBy(ts, *order)
    flagged = df.withColumn("_new", (F.row_number().over(seen) == 1).cast("long"))
    return barrier(flagged, keys, {name: (F.sum("_new"), None)}, ts, order).drop("_new").fillna({name: 0})


def entry_barrier(df: DataFrame, keys: list[str], entry: str, features: dict[str, tuple[Column, int]], ts: str = TS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``barrier`` where only rows marked ``entry`` are history and the others just ask.

    Rows are placed by twice the running number of entries, askers one later; ranges
    over that place then hold exactly the last n entries. Aggregates must
    ignore askers, whose values are null.
    """
    upto = Window.partitionBy(*keys).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    place = 2 * F.sum(F.col(entry).cast("long")).over(upto) + F.when(F.col(entry), 0).otherwise(1)
    raw = df.withColumn("_place", place)
    w = lambda n: Window.partitionBy(*keys).orderBy("_place").rangeBetween(-2 * n, -1)
    raw = raw.withColumns({f"_{name}": agg.over(w(n)) for name, (agg, n) in features.items()})
    first = batch(keys, ts, order)
    return raw.withColumns({name: F.first(f"_{name}").over(first) for name in features}).drop("_place", *[f"_{name}" for name in features])


def days_between(start: str, end: str) -> Column:
    """Days from one timestamp to another, 0 at least; null if there is no start."""
    gap = (micros(end) - micros(start)) / (DAY * 1e6)
    return F.when(F.col(start).isNotNull(), F.greatest(gap, F.lit(0.0)))


def rest_days(df: DataFrame, keys: list[str], name: str = "player_rest_days", ts: str = TS, order: tuple[str, ...] = ORDER) -> DataFrame:
    out = barrier(df, keys, {"_prev": (F.last(ts), 1)}, ts, order)
    return out.withColumn(name, days_between("_prev", ts)).drop("_prev")


def distinct_in_days(df: DataFrame, keys: list[str], what: str, days: list[int], prefix: str, ts: str = TS) -> DataFrame:
    """Distinct ``what`` within the last N days, the lower end included, the row's own time not.

    A row makes its ``what`` count from just after its time until N days later, unless a
    neighbour of the same ``what`` makes it count already or still. Starts before the row's time less ends before it
    give the counts: sums over ranges that only grow, so nothing is held per row, however many rows the days have, and
    no row is copied. A row without a time counts nothing.
    """
    same = Window.partitionBy(*keys, what).orderBy("_us")
    upto = lambda back: Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, -1 - back)
    t = df.withColumn("_us", micros(ts))
    t = t.withColumns({"_before": F.col("_us") - F.lag("_us").over(same), "_after": F.lead("_us").over(same) - F.col("_us")})
    counts = F.col(what).isNotNull() & F.col("_us").isNotNull()
    counted = {}
    for d in days:
        span = d * DAY * 1_000_000
        change = lambda gap: F.when(counts & (gap.isNull() | (gap > span)), F.lit(1)).otherwise(F.lit(0)).cast("long")  # noqa: B023, E731
        starts, ends = F.sum(change(F.col("_before"))).over(upto(0)), F.sum(change(F.col("_after"))).over(upto(span))
        counted[f"{prefix}{d}d"] = (F.coalesce(starts, F.lit(0)) - F.coalesce(ends, F.lit(0))).cast("double")
    return t.withColumns(counted).drop("_us", "_before", "_after")


def ewm(df: DataFrame, key: str, metrics: dict[str, str], spans: list[int], ts: str = TS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Exponentially weighted means of the non-null values before each timestamp, from the first value on.

    ``metrics``: column to prefix; adds ``<prefix>_ewm_<span>``. One ordered scan that
    carries a number per mean from batch to batch. Null keys are one key, rows without
    a time come first.
    """
    wanted = [(c, s, f"{p}_ewm_{s}") for c, p in metrics.items() for s in spans]
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for _, _, n in wanted]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now: object = None
        ts_now = None
        now = {n: np.nan for _, _, n in wanted}  # mean after the last row
        held = dict(now)  # mean before the last row's timestamp
        for b in batches:
            if not b.num_rows:
                continue
            key_of, when = b.column(key), b.column(ts).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            code = key_of.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first_key = np.r_[True, code[1:] != code[:-1]]
            same_key = ts_now is not None and key_of[0].as_py() == key_now
            first_key[0] = not same_key
            first = first_key | np.r_[True, when[1:] != when[:-1]]
            first[0] = not (same_key and when[0] == ts_now)
            at = np.maximum.accumulate(np.where(first, np.arange(len(when)), -1))
            segment = np.cumsum(np.r_[False, first_key]) if same_key else np.cumsum(np.r_[True, first_key])
            out = []
            for c, span, n in wanted:
                x = pd.Series(np.r_[now[n] if same_key else np.nan, b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)])
                after = x.groupby(segment).ewm(alpha=2 / (span + 1), adjust=False, ignore_na=True).mean().to_numpy()
                before = np.where(first_key, np.nan, after[:-1])
                value = np.where(at < 0, held[n], before[at])
                now[n], held[n] = after[-1], value[-1]
                out.append(pa.array(value, pa.float64(), from_pandas=True))
            key_now, ts_now = key_of[-1].as_py(), when[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *[n for _, _, n in wanted]])

    return in_order(df, [key], [ts, *order], run, schema)


def each(metrics: dict[str, str], make: Callable[[str, str], dict]) -> dict:
    out: dict = {}
    for c, p in metrics.items():
        out |= make(c, p)
    return out
