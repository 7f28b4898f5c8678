"""Incremental loading: nothing is loaded twice, whatever is replayed."""

import pytest
from pastframe.streaming import loading


def frame(spark, ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, value string")


def loaded(spark, target):
    return sorted(r.id for r in target.table(spark).collect())


@pytest.mark.parametrize("words", [1, 64])  # one word a bucket: nearly every key looks known
def test_batches_add_only_new_rows(spark, tmp_path, words):
    target = loading.Target(str(tmp_path / "t"), ("id",), buckets=4, words=words)
    loading.add_batch(frame(spark, [*range(100), 5, 5, None]), 0, target)
    loading.add_batch(frame(spark, range(50, 150)), 1, target)
    assert loaded(spark, target) == list(range(150))
    loading.add_batch(frame(spark, range(50, 150)), 1, target)  # the batch comes again
    loading.add_batch(frame(spark, []), 2, target)
    assert loaded(spark, target) == list(range(150))


def test_a_batch_lost_after_its_filters(spark, tmp_path):
    target = loading.Target(str(tmp_path / "t"), ("id",), buckets=2, words=8)
    loading.add_batch(frame(spark, range(10)), 0, target)
    half = loading.unloaded(frame(spark, range(10, 20)), target)
    new = target.bits(half.select("id", loading.BUCKET)).groupBy(loading.BUCKET, "word").agg({"bits": "bit_or"}).withColumnRenamed("bit_or(bits)", "bits")
    new.write.parquet(f"{target.filters}/batch=1")  # and then the job is lost
    loading.add_batch(frame(spark, range(10, 20)), 1, target)
    assert loaded(spark, target) == list(range(20))


def test_stream(spark, tmp_path):
    frame(spark, range(30)).write.parquet(str(tmp_path / "in"))
    target = loading.Target(str(tmp_path / "t"), ("id",), buckets=4)
    stream = spark.readStream.schema("id long, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loading.load_new(stream, target, str(tmp_path / "log")).awaitTermination()
    frame(spark, range(20, 40)).write.mode("append").parquet(str(tmp_path / "in"))
    loading.load_new(stream, target, str(tmp_path / "log")).awaitTermination()
    loading.load_new(stream, target, str(tmp_path / "log2")).awaitTermination()  # all from the start
    assert loaded(spark, target) == list(range(40))
