"""Joins with a checked grain, side selection and point-in-time lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise if a key has two rows."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for {keys}: {twice[0].asDict()}")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Left join onto a table that has one row a key."""
    if check:
        check_unique(right, keys)
    return left.join(right, keys, "left")


def only_known(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def orphans(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def other_side(own: Column | str, first: Column | str, of_first: Column, of_second: Column) -> Column:
    """The opponent's value; a null first id falls to the first side's value."""
    own, first = (F.col(c) if isinstance(c, str) else c for c in (own, first))
    return F.when(own == first, of_second).otherwise(of_first)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], order: list[str]) -> DataFrame:
    """``values`` of the last row of ``right`` with the key and a time strictly before that of ``left``.

    Both sides are united and one window per key carries the last value forward:
    one shuffle, no range join. A null key finds nothing.
    """
    have = right.where(F.col(key).isNotNull()).select(key, ts, *order, F.struct(*values).alias("_v"))
    ask = left.withColumns({"_l": F.struct(*left.columns), "_v": F.lit(None)})
    both = ask.select(key, ts, "_l", "_v", *[F.lit(None).alias(c) for c in order if c not in (key, ts)]).unionByName(
        have.select(key, ts, F.lit(None).alias("_l"), "_v", *[c for c in order if c not in (key, ts)]), allowMissingColumns=True
    )
    # At equal times questions come first, so that they see earlier rows only.
    w = Window.partitionBy(key).orderBy(F.col(ts), F.col("_l").isNull(), *[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_l is not null")
    return found.select("_l.*", *[F.when(F.col(key).isNotNull(), F.col(f"_f.{v}")).alias(v) for v in values])
