"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space as the contracts name it: blank and tab to carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BATCH = 1_000  # rows of an Arrow batch
LINKS = 1 << 16  # links that a task joins at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, one machine takes a temporary folder and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: What a worker remembers between tasks, by operator: functions that forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def forget_others(owner: str) -> None:
    """Forget what other operators than ``owner`` remember in this worker.

    A function of the module, as workers import it: what a task's own code names is copied to
    the worker, and of the copy of an operator's memory nothing would be forgotten.
    """
    for name, forget in REMEMBERED.items():
        if name != owner:
            forget()


def give_back() -> None:
    """Freed memory of Arrow and, where the C library can, of numpy and Python goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mapped(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of BATCH rows, where the session sets no size: a batch of whole texts is held by the JVM and by the worker.

    Workers live on from stage to stage; one that comes to another operator forgets
    what the last one remembered. Memory that a task has freed goes back to the system, before it too, as what was
    forgotten may be the last operator's.
    """
    owner = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH))
    return df.mapInArrow(task, schema)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_blanks(c: Column) -> Column:
    for b in BLANKS:
        c = F.replace(c, F.lit(b), F.lit(""))
    return c


def own_key(c: str | Column) -> Column:
    """The same long, computed: joined on it, a grouped table is shuffled anew, so that Spark may split the rows of a hot key."""
    return (F.col(c) if isinstance(c, str) else c).bitwiseXOR(F.lit(0))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (u, v) but the smallest of its component there, and that one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
        np.minimum.at(root, a, b)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars, LINKS or somewhat more at once."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(t[0].to_numpy(), t[1].to_numpy())], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LINKS:
            yield joined()
            held.clear()
    if held:
        yield joined()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, root).

    Each round first joins the links within tasks of about LINKS rows to stars. Then come a
    large-star and a small-star step (joins with a table of one
    row per node, so a hub's edges can be split over tasks), and a
    reliable checkpoint. root is the smallest node of the component; nodes
    without an edge don't appear. Raises if ``rounds`` don't suffice.
    """
    within = lambda df: durable(mapped(df, _stars, "u long, v long"))
    state = lambda df: df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    # Without Python here: behind Python in one stage it would take a second worker a task, and executors keep their workers.
    e = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    size = e.count()
    for _ in range(rounds):
        e = within(e.coalesce(max(1, math.ceil(size / LINKS))))
        seen = state(e)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(low.withColumn("u", own_key("u")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(low.withColumn("u", own_key("u")), "u")
        e = durable(j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct())
        now = state(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        size = now[0]
    raise RuntimeError("components() did not settle; raise rounds")
