"""One row per key, chosen by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[Column], within: list[str] | None = None) -> DataFrame:
    if within:
        rest = [k for k in keys if k not in within]
        w, own = Window.partitionBy(*within).orderBy(*rest, *order), F.struct(*rest)
        return df.withColumn("_n", F.lag(own).over(w).eqNullSafe(own)).where("not _n").drop("_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: list[str], within: list[str] | None = None) -> DataFrame:
    """The last row of each key. ``order`` must tell all rows of a key apart; Spark keeps no file order.

    ``within``: those of the keys that rows are dealt by, so that what follows finds them there; all rows of these are ordered in one task.
    """
    return _pick(df, keys, [F.col(c).desc() for c in order], within)


def keep_first_source(df: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    """The row of the first source by name, then the first in ``order``."""
    return _pick(df, keys, [F.col(source).asc(), *[F.col(c).asc() for c in order]])


def keep_any(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def latest_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each entity by an aggregation, which combines before the shuffle."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(best.alias("r")).select("r.*")
