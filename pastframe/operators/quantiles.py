"""Exact quantiles by group in two passes, without holding a group's distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # a sketch's ranks are off by one in so many of its values, at most
FEW = 100_000  # groups whose brackets are broadcast, at most


def _brackets(df: DataFrame, by: list[str], columns: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """by, and per column the number of values, and per quantile values surely not above and not below it."""
    off = 4 / accuracy
    ends = [x for p in probs for x in (max(0.0, p - off), min(1.0, p + off))]
    out = []
    for i, c in enumerate(columns):
        out += [F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_min{i}"), F.max(c).alias(f"_max{i}"), F.percentile_approx(c, ends, accuracy).alias(f"_q{i}")]
    return df.groupBy(*by).agg(*out)


def _end(i: int, at: int, accuracy: int) -> Column:
    """The lower (even ``at``) or upper end of a bracket; all values where there are so few that a sketch's step may be less than a rank."""
    return F.when(F.col(f"_n{i}") <= accuracy / 2, F.col(f"_max{i}" if at % 2 else f"_min{i}")).otherwise(F.col(f"_q{i}")[at])


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """One row per group and column: by..., column, count, and q0, q1, ... with linear interpolation, as ``percentile`` gives them.

    The first pass makes mergeable sketches, which bracket each quantile between two
    values whose ranks are about eight in ``accuracy`` values apart. The second counts
    the values below each bracket and, by distinct value, those inside, and a running sum over these finds the
    wanted ranks. Partial sums are made before both shuffles, so a hot group is spread
    over tasks; only what lies in a bracket is ordered. Nulls are not counted; a column
    without values has null quantiles; null groups are a group.
    """
    df = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    known = _brackets(df, by, columns, probs, accuracy)
    if by:
        known = known.withColumn("_group", F.struct(*by)).drop(*by)
        small = known.select("_group").limit(FEW + 1).count() <= FEW
        rows = df.withColumn("_key", F.struct(*by))
        rows = rows.join(F.broadcast(known) if small else known, F.col("_key").eqNullSafe(F.col("_group")))
    else:
        rows = df.join(F.broadcast(known))  # one row
        rows, known = rows.withColumn("_group", F.lit(0)), known.withColumn("_group", F.lit(0))
    cells = []
    for i, c in enumerate(columns):
        for j in range(len(probs)):
            low, high, x = _end(i, 2 * j, accuracy), _end(i, 2 * j + 1, accuracy), F.col(c)
            side = F.when(x < low, 0).when(x <= high, 1)
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), side.alias("side"), F.when(side == 1, x).alias("x")))
    hit = rows.select("_group", F.explode(F.filter(F.array(*cells), lambda s: s["side"].isNotNull())).alias("s")).select("_group", "s.*")
    counts = hit.groupBy("_group", "i", "j", "x").agg(F.count(F.lit(1)).alias("c"))  # x is null for all that lie below
    upto = Window.partitionBy("_group", "i", "j").orderBy(F.col("x").asc_nulls_first())
    counts = counts.withColumn("upto", F.sum("c").over(upto))
    sizes = known.select("_group", F.posexplode(F.array(*[F.col(f"_n{i}") for i in range(len(columns))])).alias("i", "n"))
    spots = counts.join(F.broadcast(sizes) if not by or small else sizes, ["_group", "i"])
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("j") + 1) * (F.col("n") - 1)
    # The least value whose running count is beyond the rank; null, if it lies below the bracket, is less than any.
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("x")))
    found = spots.withColumn("at", at).groupBy("_group", "i", "j").agg(F.first("at").alias("at"), first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b"))
    sure = F.col("a.x").isNotNull() & F.col("b.x").isNotNull()
    mixed = F.when(F.floor("at") == F.ceil("at"), F.col("a.x")).otherwise((F.ceil("at") - F.col("at")) * F.col("a.x") + (F.col("at") - F.floor("at")) * F.col("b.x"))
    value = F.when(sure, mixed).otherwise(F.raise_error(F.lit("a sketch's bracket missed its quantile")).cast("double"))
    wide = found.groupBy("_group", "i").agg(*[F.max(F.when(F.col("j") == j, value)).alias(f"q{j}") for j in range(len(probs))])
    out = sizes.join(wide.withColumnRenamed("_group", "_of"), (F.col("_group").eqNullSafe(F.col("_of"))) & (sizes.i == wide.i), "left")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), sizes.i + 1)
    return out.select(*[F.col(f"_group.{b}").alias(b) for b in by], name.alias("column"), F.col("n").alias("count"), *[f"q{j}" for j in range(len(probs))])


def medians(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by..., median: exact, per group."""
    return exact_quantiles(df, by, [column], [0.5]).select(*by, F.col("q0").alias("median"))

