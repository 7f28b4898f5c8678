"""Exact dedup by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, own_key, table, without_blanks

#: A chunk ends after one of these letters or after a byte 80 to 8F of a longer character, at 512 bytes or more, and at 4096 at the latest.
CUT = r"(?s).{512,4095}?[qxzjkwQXZJKWvbVB0-9\x80-\x8F]|.{1,4096}"
MOST = 10_000  # identifiers that stand for two chunks, at most


def chunks(c):
    """Content-defined chunks of a string, cut as UTF-8 bytes (one character a byte), so that every script is."""
    return F.regexp_extract_all(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), F.lit(CUT), F.lit(0))


def dedup_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks (space, tab to carriage
    return); null counts as empty. The row with the most code points, then the
    smallest doc_id, stays; a null doc_id comes last.

    Each normalised text is cut into content-defined chunks, once; then only their
    digests move. One aggregation over distinct chunks (combined before the shuffle)
    verifies that a 64-bit identifier stands for one chunk text; the few chunks of a
    colliding identifier are named by their SHA-256 instead (about n^2/2^65 of n
    chunks; more than ``MOST`` are an error, not a long list). Lists of identifiers,
    equal exactly when the texts are, are then grouped and joined.

    Repeated rows and ties: rows alike in length and doc_id are equal copies; one
    of them is marked kept only if doc_id is unique, otherwise all rows with the
    kept doc_id are. Empty table: empty result. Extra columns are ignored.
    """
    norm = without_blanks(F.coalesce(F.col(text), F.lit("")))
    src = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    digests = F.transform(chunks(F.col("norm")), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("s")))
    cut = durable(src.select("doc_id", "n", digests.alias("chunks"), F.sha2("norm", 256).alias("text_sha256")))
    parts = cut.select(F.explode("chunks").alias("c")).select("c.h", F.hex("c.s").alias("s"))
    shared = parts.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi")
    bad = [r.h for r in shared.select("h").limit(MOST + 1).collect()]
    if len(bad) > MOST:
        raise RuntimeError("64-bit identifiers collide too often")
    taken = F.array(*[F.lit(x) for x in bad]).cast("array<long>")
    name = lambda c: F.when(F.array_contains(taken, c.h), F.hex(c.s)).otherwise(F.hex(c.h)) if bad else F.hex(c.h)
    named = cut.select("doc_id", "n", F.transform("chunks", name).alias("recipe"), "text_sha256")
    best = F.struct("n", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"))
    groups = named.groupBy("recipe").agg(F.max_by("doc_id", best).alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.withColumn("k", own_key(F.xxhash64("recipe")))
    return named.withColumn("k", F.xxhash64("recipe")).join(groups, ["k", "recipe"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS s
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
