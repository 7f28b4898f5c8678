"""What a training run rests on: features and their groups, split, cutoffs, rolling windows, and the matches of each part."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits


def split_parts(df: DataFrame) -> DataFrame:
    """part, rows, matches, first_ts and cutoff (the last time) of each part of a table with ``split``."""
    return df.groupBy(F.col("split").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("match_id").alias("matches"), F.min("ts").alias("first_ts"), F.max("ts").alias("cutoff")
    )


def part_matches(df: DataFrame, windows: int = 3) -> DataFrame:
    """part, match_id: the matches of each split and of each rolling window's two sides, one row each; as large as the match table times the windows."""
    matches = df.select("split", "match_id").distinct().select(F.col("split").alias("part"), "match_id")
    rows = df.select("match_id", "ts")
    for i, (train, valid) in enumerate(splits.rolling_splits(rows, windows)):
        for side, part in (("train", train), ("validation", valid)):
            matches = matches.unionByName(part.select(F.lit(f"window_{i}_{side}").alias("part"), "match_id").distinct())
    return matches


def write_manifest(df: DataFrame, path: str, features: list[str], groups: dict[str, list[str]], targets: list[str], version: str, windows: int = 3) -> None:
    """A folder with ``summary`` (one JSON document: version, features, groups, targets, and of every part its counts and cutoffs) and ``matches`` (Parquet by part).

    Lists of matches grow with the data and so are a table, not part of the document. ``df``: a feature table with its split.
    """
    spark = df.sparkSession
    part_matches(df, windows).write.mode("overwrite").partitionBy("part").parquet(f"{path}/matches")
    times = df.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("ts"))
    per = spark.read.parquet(f"{path}/matches").join(times, "match_id").groupBy("part")
    per = per.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("matches"), F.min("first_ts").alias("first_ts"), F.max("ts").alias("cutoff"))
    parts = {r.part: {"rows": r["rows"], "matches": r.matches, "first_ts": str(r.first_ts), "cutoff": str(r.cutoff)} for r in per.collect()}  # one row a part
    document = {"version": version, "features": features, "feature_groups": groups, "targets": targets, "parts": parts}
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The document, and the table (part, match_id)."""
    return json.loads(spark.read.text(f"{path}/summary").first().value), spark.read.parquet(f"{path}/matches")
