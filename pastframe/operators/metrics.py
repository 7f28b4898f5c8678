"""Regression metrics, slices, baselines and affine calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import experience_bucket
from .distinct import one_row
from .graph import checkpointed
from .quantiles import medians
from .splits import time_periods


FEW = 100_000  # rows of a counted table that are broadcast, at most


def _clean(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(y) & ~F.isnan(p))


MEASURES = ["n", "mae", "rmse", "r2", "spearman"]


def _aggregates(y: str, p: str) -> list[Column]:
    e = F.col(y) - F.col(p)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(F.lit(1))
    return [F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(sst > 0, 1 - sse / F.when(sst > 0, sst)).alias("r2")]


def average_ranks(df: DataFrame, c: str, name: str, by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """Average rank of ``c`` (within ``by``): counts per distinct value, running sums over values only. A row stands for ``times`` rows.

    The distinct values are dealt by ranges of (by, c), and each range adds what its
    slice has in the ranges before it, so no task sees all rows of a slice.
    """
    by = by or []
    n = df.groupBy(*by, c).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n")).repartitionByRange(*by, c)
    n = checkpointed(n.withColumn("_part", F.spark_partition_id()))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = n.groupBy(*by, "_part").agg(F.sum("_n").alias("_s"))  # a row for each slice of a range
    start = start.select(*by, "_part", F.coalesce(F.sum("_s").over(before(by, "_part")), F.lit(0)).alias("_start"))
    below = F.coalesce(F.sum("_n").over(before([*by, "_part"], c)), F.lit(0))
    start = start if by else F.broadcast(start)
    ranks = n.join(start, [*by, "_part"]).select(*by, c, (F.col("_start") + below + (F.col("_n") + 1) / 2).alias(name))
    return df.join(F.broadcast(ranks) if n.count() <= FEW else ranks, [*by, c])


def _measured(d: DataFrame, y: str, p: str, by: list[str], measures: list[str]) -> DataFrame:
    """The measures of cleaned rows by slice (one row without ``by``).

    Ranks are of distinct pairs of values, each with how often it stands in a slice, as these can be far fewer than the rows.
    """
    direct = d.groupBy(*by).agg(*[c for c, name in zip(_aggregates(y, p), MEASURES, strict=False) if name in ("n", *measures)])
    if "spearman" not in measures:
        return direct.select(*by, *measures)
    direct = checkpointed(direct)
    pairs = checkpointed(d.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("_times")))  # read for each rank and for both
    ranked = average_ranks(average_ranks(pairs, y, "_ry", by, "_times"), p, "_rp", by, "_times")
    few = F.broadcast if direct.count() <= FEW else lambda x: x
    size = direct.select(*by, F.col("n").alias("_size"))
    ranked = ranked.join(few(size), by) if by else ranked.crossJoin(F.broadcast(size))
    # The mean of average ranks is known, so ranks are centred without a sum of large squares.
    a, b = (F.col(c) - (F.col("_size") + 1) / 2 for c in ("_ry", "_rp"))
    over = lambda x: F.sum(F.col("_times") * x)
    r = F.try_divide(over(a * b), F.sqrt(over(a * a)) * F.sqrt(over(b * b))).alias("spearman")  # null for constants, where corr fails
    out = direct.join(few(ranked.groupBy(*by).agg(r)), by, "left") if by else direct.crossJoin(ranked.agg(r))
    return out.select(*by, *measures)


def metrics(df: DataFrame, y: str = "actual", p: str = "prediction", measures: list[str] | None = None) -> DataFrame:
    """One row: n, mae, rmse, r2 (null for a constant y), spearman (average ranks for ties), or those of them that ``measures`` names."""
    return _measured(_clean(df.select(y, p), y, p), y, p, [], measures or MEASURES)


def sliced_metrics(df: DataFrame, by: str, y: str = "actual", p: str = "prediction") -> DataFrame:
    """The same per value of a slice, ranks within it."""
    d = _clean(df.select(by, y, p), y, p).withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("__unknown__")))
    return _measured(d, y, p, [by], MEASURES)


def slice_columns(df: DataFrame) -> DataFrame:
    """Scored feature rows with the slices made of them: experience_bucket, role_experience, known_opponent, known_map, roster_stability, time_period."""
    label = lambda when, yes, no: F.when(F.coalesce(when, F.lit(False)), yes).otherwise(no)
    out = df.withColumns(
        {
            "experience_bucket": experience_bucket("player_matches_played"),
            "role_experience": experience_bucket("player_role_matches_played"),
            "known_opponent": label(F.col("opponent_rating_last_5").isNotNull(), "known", "unknown"),
            "known_map": label(F.col("player_map_matches_played") > 0, "known", "unknown"),
            "roster_stability": label(F.col("lineup_continuity") >= 0.8, "stable", "changed_or_unknown"),
        }
    )
    return time_periods(out, ["ts", "match_id", "map", "player_id"])


SLICES = ["map", "agent", "role", "experience_bucket", "time_period", "known_opponent", "known_map", "roster_stability", "role_experience"]


def slice_report(df: DataFrame, slices: list[str] | None = None, y: str = "actual", p: str = "prediction") -> DataFrame:
    """slice, value and the metrics of each value of each slice that ``df`` has; ranks within it."""
    names = [c for c in slices or SLICES if c in df.columns]
    pairs = [F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c).cast("string"), F.lit("__unknown__")).alias("value")) for c in names]
    d = _clean(df.select(F.col(y).alias("_y"), F.col(p).alias("_p"), F.explode(F.array(*pairs)).alias("_s")), "_y", "_p").select("_s.*", "_y", "_p")
    return _measured(d, "_y", "_p", ["slice", "value"], MEASURES)


def with_constants(df: DataFrame, train: DataFrame, target: str, median: bool = True) -> DataFrame:
    """Train-only mean and median (if wanted, as it takes two passes more) as columns of every row."""
    one = train.agg(F.avg(target).alias("train_mean"))
    one = one_row([one, medians(train, [], target).withColumnRenamed("median", "train_median")]) if median else one
    return df.join(F.broadcast(one))  # one row


def baseline_predictions(df: DataFrame, train: DataFrame, target: str, last: str, rolling: str) -> DataFrame:
    """Global mean and median, the entity's own means with the global mean where it has no history."""
    out = with_constants(df, train, target)
    return out.withColumns({"baseline_history": F.coalesce(last, "train_mean"), "baseline_rolling": F.coalesce(rolling, "train_mean")})


def fit_calibration(df: DataFrame, y: str = "actual", p: str = "prediction", low: float = 0.25, high: float = 3.0) -> dict:
    """slope, intercept, enabled, reason of an affine correction fitted on validation rows; off unless it lowers their MAE."""
    off = {"enabled": False, "slope": 1.0, "intercept": 0.0}
    d = _clean(df.select(y, p), y, p)
    s = d.agg(F.count(F.lit(1)).alias("n"), F.covar_pop(p, y).alias("c"), F.var_pop(p).alias("v"), F.avg(y).alias("my"), F.avg(p).alias("mp")).first()
    if s.n < 3:
        return off | {"reason": "insufficient_validation_rows"}
    if s.v is None or s.v != s.v or s.v <= 1e-12:
        return off | {"reason": "constant_raw_prediction"}
    slope = s.c / s.v
    if slope != slope or slope <= 0:
        return off | {"reason": "non_positive_validation_slope"}
    slope = min(max(slope, low), high)
    cut = s.my - slope * s.mp
    e = d.agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("raw"), F.avg(F.abs(F.col(y) - (F.col(p) * slope + cut))).alias("new")).first()
    if e.new < e.raw:
        return {"enabled": True, "slope": slope, "intercept": cut, "reason": "validation_mae_improved"}
    return off | {"reason": "validation_mae_not_improved"}


def apply_calibration(p: Column | str, c: dict | None) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return p * c["slope"] + c["intercept"] if c and c.get("enabled") else p
