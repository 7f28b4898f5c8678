"""Profiles of wide tables: missing values, distributions, correlations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, medians

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def long_form(row: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    return row.unpivot([], columns, name, value)


def null_counts(df: DataFrame) -> DataFrame:
    """column, missing, percent: one pass, then turned."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns])
    out = one.unpivot(["_n"], df.columns, "column", "missing")
    return out.select("column", "missing", F.when(F.col("_n") > 0, F.col("missing") * 100.0 / F.col("_n")).alias("percent"))


def deletion_cost(df: DataFrame) -> DataFrame:
    """What requiring each column would delete: column, missing, percent, rows_deleted, rows_retained."""
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    out = null_counts(df).join(F.broadcast(rows))  # one row
    return out.select("column", "missing", "percent", F.col("missing").alias("rows_deleted"), (F.col("_rows") - F.col("missing")).alias("rows_retained"))


def nulls_per_row(df: DataFrame) -> DataFrame:
    """How many rows have how many nulls."""
    n = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns])
    return df.groupBy(n.alias("missing_columns")).agg(F.count(F.lit(1)).alias("rows"))


def null_patterns(df: DataFrame) -> DataFrame:
    """Which columns are null together, with each pattern's share of incomplete rows."""
    flags = F.concat_ws(" | ", *[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in df.columns])
    g = df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("rows")).where("pattern <> ''")
    total = g.agg(F.sum("rows").alias("_t"))
    return g.join(F.broadcast(total)).select("pattern", "rows", (F.col("rows") * 100.0 / F.col("_t")).alias("percent"))


def drop_strategies(df: DataFrame) -> DataFrame:
    """What dropping incomplete rows, or incomplete columns, keeps."""
    whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in df.columns])
    n = F.count(F.lit(1))
    clean = reduce(lambda a, b: a + b, [(F.count(F.col(f"`{c}`")) == n).cast("long") for c in df.columns])
    one = df.agg(n.alias("n"), F.sum(whole.cast("long")).alias("complete"), clean.alias("columns"))
    return one.select(
        F.explode(
            F.array(
                F.struct(F.lit("drop_rows").alias("strategy"), F.col("complete").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")),
                F.struct(F.lit("drop_columns").alias("strategy"), F.col("n").alias("rows"), F.col("columns").alias("columns")),
            )
        ).alias("s"),
        "n",
    ).select("s.*", (F.col("s.rows") * 100.0 / F.col("n")).alias("kept_percent"))


def null_cluster(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all, with any of the columns null, and what is left after dropping either."""
    nulls = [F.col(c).isNull() for c in columns]
    every, some = reduce(lambda a, b: a & b, nulls), reduce(lambda a, b: a | b, nulls)
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.sum(every.cast("long")).alias("all_null"), F.sum(some.cast("long")).alias("any_null")).withColumns(
        {"left_without_all_null": F.col("rows") - F.col("all_null"), "left_without_any_null": F.col("rows") - F.col("any_null")}
    )


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, quartiles, max; exact quantiles with linear interpolation."""
    stats = lambda c: F.struct(
        F.lit(c).alias("column"),
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max"),
    )
    one = df.agg(*[stats(c).alias(c) for c in columns]).select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    q = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75]).select("column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    return one.join(F.broadcast(q), "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")  # a row per column


def describe_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct (null counts as a value), mode (ties: the smaller value) and its count."""
    t = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    g = t.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = g.where("value is not null").groupBy("column").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("t"))
    d = g.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return d.join(top, "column", "left").select("column", "distinct", F.col("t.value").alias("mode"), F.col("t.n").alias("mode_count"))


def by_category(df: DataFrame, category: str, target: str) -> DataFrame:
    means = df.groupBy(category).agg(F.count(target).alias("count"), F.avg(target).alias("mean"))
    m = medians(df, [category], target).withColumnRenamed(category, "_category")
    return means.join(m, F.col(category).eqNullSafe(F.col("_category"))).drop("_category")


_MOMENTS = ["n", "sx", "sy", "qx", "qy", "p"]


def _moments(width: int, centre: np.ndarray):
    """Sums over a task's rows for every pair of columns, where both are known: count, sums, squares and products around ``centre``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1) - centre
            here = np.isfinite(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(width)
        n, s, q, p = total
        cols = [i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["i", "j", *_MOMENTS])

    return run


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair of columns over the rows where both are known (finite).

    After the means, one pass: each task multiplies its rows' matrix, unknown values masked,
    with itself, and sends one row per pair of columns, whatever its number of rows.
    """
    some = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    means = some.agg(*[F.avg(finite(c)) for c in some.columns]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    per = some.mapInArrow(_moments(len(columns), centre), "i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS))
    t = per.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in _MOMENTS])
    n, sx, sy, qx, qy, p = (F.col(m) for m in _MOMENTS)
    spread = (n * qx - sx * sx) * (n * qy - sy * sy)
    # What is left of a constant column is rounding.
    flat = lambda q, s: n * q - s * s <= 1e-12 * n * q
    r = F.when((n > 0) & (spread > 0) & ~flat(qx, sx) & ~flat(qy, sy), (n * p - sx * sy) / F.sqrt(F.when(spread > 0, spread)))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    t = t.select(name("i").alias("a"), name("j").alias("b"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    return t.union(t.where("a <> b").select("b", "a", "r"))


def target_ranking(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Columns by the absolute value of their correlation with the target."""
    r = correlations(df, [*columns, target]).where((F.col("a") == target) & (F.col("b") != target))
    return r.select(F.col("b").alias("column"), "r").orderBy(F.abs("r").desc(), "column")


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles and whisker ends (1.5 interquartile ranges) per group."""
    q = exact_quantiles(df, [by], [value], [0.25, 0.5, 0.75]).select(by, F.col("q0").alias("q1"), F.col("q1").alias("q2"), F.col("q2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    ends = df.join(q, by).where(F.col(value).between(lo, hi)).groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(ends, by)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin (1 to bins) and count over equal widths between minimum and maximum."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("count")).limit(0)
    b = F.least(F.floor((F.col(value) - lo) * bins / (hi - lo if hi > lo else 1)) + 1, F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def fill_by_role(df: DataFrame, columns: list[str], role: str = "role") -> DataFrame:
    """Nulls become the role's mean, what is still null the mean after that. Rows without a role go."""
    means = df.groupBy(role).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    out = df.join(means, role).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
    every = out.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return out.join(F.broadcast(every)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def active_years(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """How many entities were active in how many years."""
    n = df.groupBy(entity).agg(F.count_distinct(F.year(ts)).alias("years"))
    return n.groupBy("years").agg(F.count(F.lit(1)).alias("entities"))
