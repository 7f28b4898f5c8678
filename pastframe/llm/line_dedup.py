"""Line dedup: lines that many sites carry, found by HyperLogLog sketches, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, durable, own_key, table

MIN_SITES = 5  # a line on at least so many sites is cross-site boilerplate
BAND = 0.5  # estimates within this share of the threshold are settled by exact counts
FEW = 1_000_000  # line hashes that are broadcast, at most
LG_K = 8  # 256 registers: standard error 6.5 %, far inside the band


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of boilerplate lines with their first occurrence.

    ``lines``: h1, h2, site, doc_id, pos. Sketches merge before and after the
    shuffle; lines estimated near the threshold are counted exactly.
    """
    sketch = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", LG_K).alias("sk"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")
    )
    lo, hi = min_sites * (1 - BAND), min_sites * (1 + BAND)
    est = sketch.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sk").alias("est"))
    est = durable(est.where(F.col("est") >= lo))
    sure, near = est.where(F.col("est") > hi), est.where(F.col("est") <= hi)
    # Distinct first: a hot line has a row per site then, not one per occurrence.
    sites = lines.select("h1", "h2", "site").join(_few(near.select("h1", "h2")), ["h1", "h2"], "left_semi").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return durable(sure.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")))


def _few(lines: DataFrame) -> DataFrame:
    """For a broadcast if they are FEW or fewer; else shuffled on a key of their own, so that a hot line's rows can be split."""
    return F.broadcast(lines) if lines.count() <= FEW else lines.withColumn("h1", own_key("h1"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """Remove repeats of cross-site boilerplate lines from every document.

    A line (between newlines, compared without blanks at its ends; blank lines
    never count) is boilerplate when at least ``min_sites`` distinct sites carry
    it. Its first occurrence (smallest doc_id, then position) stays, so that
    nothing vanishes from the corpus; every other occurrence goes. Returns the
    columns of ``docs`` with the new text, n_chars set anew where it exists, and
    lines_total, lines_removed.

    Null text stays null with no lines; a null site counts as the empty one; null
    doc_id sorts first. Repeated rows are the same occurrence: all keep or all lose
    a line. Empty table: empty result. Columns of ``docs`` named lines_total or
    lines_removed are replaced; no other name can clash.
    """
    docs = docs.drop("lines_total", "lines_removed")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    src = docs.select(row, F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    every = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col(site), F.lit("")).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).withColumn("line", F.trim("line", F.lit(BLANKS)))
    lines = every.where("line <> ''").select("doc_id", "h", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    marked = lines.join(_few(spread(lines, min_sites)), ["h1", "h2"])
    gone = marked.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first"))).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("gone"))
    both = src.join(gone, src.id.eqNullSafe(gone.doc_id) & (src.h == gone.h), "left").select("row", "gone")
    old = F.col(f"row.`{text}`")
    # The parts are bound once, as the lambda's variable, and kept positions found by hash: linear in the lines.
    kept = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "gone")
    clean = F.transform(F.array(F.split(old, "\n")), lambda p: F.array_join(F.transform(kept(p), lambda i: F.get(p, i)), "\n"))[0]
    new = F.when(F.col("gone").isNull(), old).otherwise(clean)
    out = both.select("row", "gone", new.alias("new"))
    values = {text: F.col("new")} | ({"n_chars": F.length("new").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(
        *[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns],
        F.when(old.isNull(), 0).otherwise(F.size(F.split(old, "\n"))).cast("long").alias("lines_total"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("lines_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "lines_total", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("clean_chars"))


SQL = r"""
WITH w AS (SELECT chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
s AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(range(len(parts))) AS pos, unnest(parts) AS raw FROM s),
t AS (SELECT doc_id, site, pos, raw, trim(raw, b) AS line FROM l, w),
x AS (SELECT line, count(DISTINCT site) AS sites, min({'d': doc_id, 'p': pos}) AS f FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
g AS (SELECT t.doc_id, t.pos, t.raw, x.line IS NOT NULL AND {'d': t.doc_id, 'p': t.pos} <> x.f AS gone FROM t LEFT JOIN x ON t.line = x.line),
a AS (SELECT doc_id, count(*) AS n, sum(gone::INT) AS k, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS txt FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS lines_total, coalesce(a.k, 0)::BIGINT AS lines_removed, sha256(coalesce(a.txt, '')) AS clean_sha256, length(coalesce(a.txt, ''))::BIGINT AS clean_chars
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
