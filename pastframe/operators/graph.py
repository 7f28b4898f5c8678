"""Connected components of small entity graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, one machine takes a temporary folder and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared folder as compressed columns and read back, so that their lineage ends here.

    Checkpoints of Spark hold whole rows uncompressed, several times as much. Files of the shuffles that
    led here stay until the driver's collector finds them unused, so it is asked to look. A column without a type can't be written so.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if any("void" in kind for _, kind in df.dtypes):
        return df.checkpoint(eager=True)
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def components(pairs: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, by joins that spread the least label and jump to its label."""
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    both = checkpointed(both.union(both.select("v", "u")).union(both.select("u", "u")).union(both.select("v", "v")).distinct())
    label = both.groupBy("u").agg(F.min("v").alias("l"))
    label = checkpointed(label)
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("l"))
        jump = near.join(label.select(F.col("u").alias("l"), F.col("l").alias("m")), "l").select("u", F.least("l", "m").alias("l"))
        new = checkpointed(jump)
        changed = new.join(label.withColumnRenamed("l", "o"), "u").where("l <> o").limit(1).count()
        label = new
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
    raise RuntimeError("components() did not settle; raise rounds")


def with_component(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the component that its pair (a, b) belongs to."""
    c = components(df.select(a, b), a, b)
    return df.join(c.select(F.col("node").alias(a), F.col("component").alias(name)), a)
