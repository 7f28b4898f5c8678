"""Incremental loading of arriving rows: what the target holds already is told by Bloom filters, and read only to confirm."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import exists

BUCKET = "load_bucket"
FEW = 1_000_000  # words of filters that are broadcast, at most


@dataclass(frozen=True)
class Target:
    """A table partitioned by buckets of its key, and beside it a Bloom filter of each bucket's keys.

    The filters are kept as words of 64 bits, (bucket, word, bits), one folder a
    batch; a filter is the bitwise or of its words over the folders. ``words`` per
    bucket and ``hashes`` say how many keys a filter tells apart: with 16 bits a key
    and 5 hashes about one key in 500 is confirmed in vain. Neither changes the result.
    """

    path: str
    key: tuple[str, ...]
    buckets: int = 64
    words: int = 4_096
    hashes: int = 5

    @property
    def rows(self) -> str:
        return f"{self.path}/rows"

    @property
    def filters(self) -> str:
        return f"{self.path}/filters"

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.lit(0), *self.key), F.lit(self.buckets)).cast("int"))

    def bits(self, df: DataFrame) -> DataFrame:
        """A row per key and hash: the word and the bit in it."""
        at = lambda i: F.pmod(F.xxhash64(F.lit(i), *self.key), F.lit(self.words * 64))
        spot = df.withColumn("_at", F.explode(F.array(*[at(i + 1) for i in range(self.hashes)])))
        return spot.withColumns({"word": F.floor(F.col("_at") / 64).cast("int"), "bits": F.expr("shiftleft(1L, cast(_at % 64 as int))")}).drop("_at")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.rows).drop(BUCKET)


def _asked(batch: DataFrame, target: Target) -> DataFrame:
    """``batch`` with its bucket and ``maybe``: whether a filter takes the key for known."""
    spark = batch.sparkSession
    batch = target.placed(batch)
    if not (exists(spark, target.rows) and exists(spark, target.filters)):
        return batch.withColumn("maybe", F.lit(False))
    known = spark.read.schema(f"{BUCKET} int, word int, bits long").parquet(target.filters).groupBy(BUCKET, "word").agg(F.bit_or("bits").alias("have"))
    known = F.broadcast(known) if target.buckets * target.words <= FEW else known  # a row a word
    asked = target.bits(batch.select(*target.key, BUCKET)).join(known, [BUCKET, "word"], "left")
    hit = (F.col("bits").bitwiseAND(F.coalesce("have", F.lit(0).cast("long"))) == F.col("bits")).cast("int")
    hits = asked.groupBy(*target.key, BUCKET).agg((F.min(hit) == 1).alias("maybe"))
    return batch.join(hits, [*target.key, BUCKET], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def _new(asked: DataFrame, target: Target) -> DataFrame:
    """Rows of ``_asked`` that the target doesn't hold. It is read in the buckets of those that may be known, and only these rows are compared."""
    spark, columns = asked.sparkSession, [c for c in asked.columns if c != "maybe"]
    where = [r[0] for r in asked.where("maybe").select(BUCKET).distinct().collect()]  # buckets, a fixed number
    if not where:
        return asked.select(columns)
    have = spark.read.schema(asked.select(*target.key, BUCKET).schema).parquet(target.rows).where(F.col(BUCKET).isin(where))
    unknown = asked.where("maybe").join(have, [*target.key, BUCKET], "left_anti")
    return asked.where("not maybe").select(columns).unionByName(unknown.select(columns))


def unloaded(batch: DataFrame, target: Target) -> DataFrame:
    """Rows of ``batch`` whose key the target doesn't hold; the target is read in those buckets only where a filter takes a key for known."""
    return _new(_asked(batch, target), target)


def add_batch(batch: DataFrame, number: int, target: Target) -> None:
    """Append what is new in one micro-batch. Run again, a batch adds nothing.

    Filters are written before rows: if the job is lost between the two, the batch comes
    again, its keys look known, and the rows say that they aren't. Bits are only ever added.
    Rows are dealt by bucket before they are written, so that a batch adds one file to a bucket, not one a task.
    """
    known = F.expr(" and ".join(f"{k} is not null" for k in target.key))
    asked = _asked(batch.dropDuplicates(list(target.key)).where(known), target).persist()
    fresh = _new(asked, target).persist()
    try:
        new = target.bits(fresh.select(*target.key, BUCKET)).groupBy(BUCKET, "word").agg(F.bit_or("bits").alias("bits"))
        new.write.mode("append").parquet(f"{target.filters}/batch={number}")
        fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(target.rows)
    finally:
        fresh.unpersist()
        asked.unpersist()


def load_new(stream: DataFrame, target: Target, checkpoint: str) -> StreamingQuery:
    """Append rows whose key isn't loaded yet; available files are taken once, then the query ends. Rows without a key are left out."""
    return stream.writeStream.foreachBatch(lambda b, n: add_batch(b, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
