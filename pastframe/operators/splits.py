"""Global order without a single-partition window; time splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

# Columns that are known only after a map, and ids.
TARGETS = ["rating2_all", "acs_all", "kda_all"]
IDS = ["player_id", "team_id", "opponent_team_id", "match_id", "event_id"]
SIDED = ["rating2", "acs", "kills", "deaths", "assists", "adr", "kast", "hsp", "fb", "fd"]
AFTER_MAP = [f"{m}_{s}" for m in SIDED for s in ("all", "t", "ct")] + [
    "kda_all", "map_winner", "first_half_ct_win_rounds", "first_half_t_win_rounds", "second_half_ct_win_rounds",
    "second_half_t_win_rounds", "ot_team_ct_win", "ot_team_t_win",
]


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0-based place of each row in a total order: ranges, then per-range numbers plus an offset (one row a partition)."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    size = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = size.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + place).drop("_part", "_start")


def time_periods(df: DataFrame, order: list[str], q: int = 4) -> DataFrame:
    """Quantile bins of the time order, edges interpolated: bin 0 to q-1."""
    df = checkpointed(df)  # counted, sampled for its ranges and numbered
    n = df.count()
    q = min(q, n)
    r = F.col("_r")
    out = numbered(df, order, "_r")
    period = F.lit(0) if n < 2 else F.greatest(F.lit(0), F.ceil(r * float(q) / (n - 1)) - 1)
    return out.withColumn("time_period", period.cast("int")).drop("_r")


def match_order(df: DataFrame, match: str = "match_id", ts: str = "ts") -> DataFrame:
    """(match, ts, match_idx): whole matches in time order. Raises if a row has no match or no timestamp: it has no place in time."""
    lost = df.where(F.col(match).isNull() | F.col(ts).isNull()).count()
    if lost:
        raise ValueError(f"{lost} rows without {match} or {ts}")
    return numbered(df.groupBy(match).agg(F.min(ts).alias(ts)), [ts, match], "match_idx")


def bounds(n: int, train: float = 0.70, valid: float = 0.15) -> tuple[int, int]:
    """How many of ``n`` matches end the training part and the validation part; no part is empty if there are three or more."""
    if not (0 < train < 1 and 0 <= valid < 1 and train + valid < 1):
        raise ValueError("the shares of training and validation leave some for the test")
    a = max(1, int(n * train))
    return a, max(a + 1, min(int(n * (train + valid)), n - 1))


def chronological_split(df: DataFrame, train: float = 0.70, valid: float = 0.15, match: str = "match_id", ts: str = "ts") -> DataFrame:
    """``df`` with split (train, validation, test); a match is never divided. Rows without a timestamp are an error."""
    order = checkpointed(match_order(df, match, ts))
    a, b = bounds(order.count(), train, valid)
    part = F.when(F.col("match_idx") < a, "train").when(F.col("match_idx") < b, "validation").otherwise("test")
    return df.join(order.select(match, "match_idx", part.alias("split")), match)


def window_starts(n: int, k: int = 3, first: float = 0.45, horizon: float = 0.10, last: float = 0.85) -> list[tuple[int, int]]:
    """(start, end) of the validation part of each expanding window, as numbers of matches; at least one match on each side."""
    if k < 1 or horizon <= 0 or not 0 < first < last <= 1 or first + horizon > last:
        raise ValueError("the windows don't fit before the test")
    h = max(1, int(n * horizon))
    lo = max(1, int(n * first))
    hi = max(lo, int(n * last) - h)
    points = {lo + int((hi - lo) * i / (k - 1)) for i in range(k)} if k > 1 else {lo}
    return [(s, min(s + h, n)) for s in sorted(points) if s < n]


def rolling_splits(df: DataFrame, k: int = 3, match: str = "match_id", ts: str = "ts") -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) of each window, filtered by index from one copy of the rows with their match's index; what trains on them reads them often."""
    order = checkpointed(match_order(df, match, ts))
    rows = checkpointed(df.join(order.select(match, "match_idx"), match))
    return [(rows.where(F.col("match_idx") < s), rows.where((F.col("match_idx") >= s) & (F.col("match_idx") < e))) for s, e in window_starts(order.count(), k)]


def ensure_no_leakage(features: list[str], target: str) -> None:
    """Raise if a feature is a target, an id or known only after the map."""
    bad = sorted(set(features) & ({target} | set(TARGETS) | set(IDS) | set(AFTER_MAP)))
    if bad:
        raise ValueError(f"leaky features: {bad}")
