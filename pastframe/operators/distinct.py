"""Counts of distinct and repeated rows: fingerprints first, whole rows only where these repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns that can be compared: maps and such as text."""
    kinds = dict(df.dtypes)
    return [F.to_json(F.col(f"`{c}`")).alias(c) if "map<" in kinds[c] else F.col(f"`{c}`") for c in columns]


def distinct_rows(df: DataFrame, columns: list[str] | None = None, fingerprint: Column | None = None) -> DataFrame:
    """One row: rows, distinct (nulls equal each other).

    Rows are counted by a 64-bit fingerprint (8 bytes a row go through the shuffle, after partial
    counts). Only rows whose fingerprint stands more than once are compared as a whole, so rows that
    share it by chance are told apart.
    """
    rows = df.select(*_plain(df, columns or df.columns))
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) if fingerprint is None else fingerprint
    rows = rows.withColumn("_mark", mark)
    marks = rows.groupBy("_mark").agg(F.count(F.lit(1)).alias("_times"))
    often = marks.where("_times > 1").select(F.col("_mark").bitwiseXOR(F.lit(0)).alias("_mark"))
    whole = rows.join(often, "_mark", "left_semi").groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.lit(1).alias("_one"))
    both = marks.agg(F.sum("_times").alias("rows"), F.sum((F.col("_times") == 1).cast("long")).alias("distinct")).unionByName(
        whole.agg(F.lit(0).cast("long").alias("rows"), F.count("_one").alias("distinct"))
    )
    return both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))


def repeated(df: DataFrame, columns: list[str] | None, name: str, fingerprint: Column | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    return distinct_rows(df, columns, fingerprint).select((F.col("rows") - F.col("distinct")).alias(name))


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Frames of one row each as one row, their columns side by side."""
    every = [c for p in parts for c in p.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(f"`{c}`").alias(c) for c in every])
