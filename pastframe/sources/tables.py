"""Reading and writing tables: subsets of columns, fallbacks, regional files, resuming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """CSV files have a header; give their schema, as inferring it reads them twice."""
    r = spark.read.format(format)
    if format == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).load(path)


def only_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, so that the scan reads no others."""
    return df.select([c for c in df.columns if c in set(wanted)])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_preferred(spark: SparkSession, preferred: str, fallback: str, format: str = "parquet") -> DataFrame:
    """The preferred path, else the other; an error that names both if there is neither."""
    for path in (preferred, fallback):
        if exists(spark, path):
            return read(spark, path, format)
    raise FileNotFoundError(f"neither {preferred} nor {fallback} exists")


def merge_regions(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of regional ones with a region column; columns that some lack become null."""
    tagged = [df.drop("region").withColumn("region", F.lit(name)) for name, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write(df: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format(format)
    if format == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """The catalog table ``name`` over files in ``path``, hashed by ``keys`` into buckets and sorted within them; it is read back.

    What groups, dedups or joins by the keys, or by more columns than them, then needs no
    shuffle. One shuffle deals the rows here, so that each bucket is one sorted file; a key
    of very many rows makes one large file. Joins on more columns than the keys are spared
    only with ``spark.sql.requireAllClusterKeysForCoPartition`` off. Give tables that are
    joined the same number of buckets, or multiples. A table of that name is replaced.
    """
    w = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    w.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def not_loaded(matches: DataFrame, loaded: DataFrame, key: str = "match_id") -> DataFrame:
    """Matches that an earlier run hasn't loaded."""
    return matches.join(loaded.select(key).distinct(), key, "left_anti")
