"""URL filters: host-suffix and path-prefix expressions against a rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, own_key, table

PREFIX = 8  # hex digits of the digest that the join compares
FEW = 100_000  # rules that are broadcast, at most

#: The rules of the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def split_url(url):
    """Host (A-Z lower-cased) and path columns; both empty for null or no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``rules`` has verdict, host, path. A rule fits its host and all subdomains
    when the url's path starts with the rule's. The longest host+path wins; of
    equally long ones the longer host, then ``block``. Rows that no rule fits
    get a null rule and ``default``. Each distinct (host, path) is expanded into
    the suffixes of its host at dots and the prefixes of its path at slashes, joined on the first
    digits of a digest with the folders that rules stand in, and confirmed on the whole
    digest. A folder knows the lengths of its rules: the url's prefixes of these
    are joined and confirmed in the same way. So the work for a url follows its labels and slashes, and what
    its own folders hold, not the variety of the rules. The verdicts go back to the rows on a computed key, so that Spark may split the
    rows of a hot url, such as all null ones.

    Null or malformed urls: empty host and path, thus ``default``. Repeated rows
    stay repeated; an empty ``pages`` gives an empty result; columns of
    ``pages`` named host, path, rule or verdict are replaced.
    """
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    start = lambda c: F.substring(c, 1, PREFIX)
    r = rules.where("host is not null and path is not null").select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("hl"),
        F.length("path").alias("pl"),
        "host",
        F.regexp_extract("path", r"(?s)^(?:.*/)?", 0).alias("folder"),
        digest(F.col("host"), F.col("path")).alias("full"),
    )
    r = r.withColumn("short", start(F.col("full")))
    # The most labels and slashes of a rule: two integers.
    slashes = F.size(F.split("folder", "/"))
    most = r.agg(F.max(F.size(F.split("host", r"\."))), F.max(slashes), F.count("*")).first()
    # Lengths in a folder are at most as many as the characters of its longest rule.
    folders = r.groupBy("host", "folder").agg(F.collect_set("pl").alias("lengths")).select(digest(F.col("host"), F.col("folder")).alias("key"), "lengths")
    folders = folders.withColumn("short", start(F.col("key")))
    best_rules = r.select("verdict", "rule", "hl", "full", "short")
    if most[2] <= FEW:
        folders, best_rules = F.broadcast(folders), F.broadcast(best_rules)
    host, path = split_url(F.col(url))
    kept = pages.drop("host", "path", "rule", "verdict")
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), host.alias("host"), path.alias("path"))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    up_to = lambda n, limit: F.sequence(F.lit(1), F.least(F.size(n), F.lit(limit or 1)))
    suffixes = F.transform(up_to(labels, most[0]), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    prefixes = F.transform(up_to(parts, most[1]), lambda n: F.when(n > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), "/"), F.lit("/"))).otherwise(""))
    tried = rows.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).withColumn("digest", F.explode(F.transform(prefixes, lambda p: digest(F.col("suffix"), p))))
    known = tried.withColumn("short", start(F.col("digest"))).join(folders, "short")
    # Joined on digits alone; a folder that only shares them has no lengths here.
    sure = F.when(F.col("digest") == F.col("key"), F.col("lengths"))
    exact = known.select("host", "path", "suffix", F.explode(F.filter(sure, lambda n: n <= F.length("path"))).alias("n"))
    exact = exact.select("host", "path", digest(F.col("suffix"), F.expr("substring(path, 1, n)")).alias("digest"))
    near = exact.withColumn("short", start(F.col("digest"))).join(best_rules, "short")
    # The whole digest is confirmed here: a rule that only shares the prefix has no order and can't be the best.
    order = F.when(F.col("digest") == F.col("full"), F.struct(F.length("rule"), F.col("hl"), (F.col("verdict") == "block").cast("int")))
    best = near.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best")).where("best is not null")
    best = best.withColumn("k", own_key(F.xxhash64("host", "path")))
    found = rows.withColumn("k", F.xxhash64("host", "path")).join(best, ["k", "host", "path"], "left")
    return found.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept.columns],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r(verdict, h, t) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
m AS (
  SELECT p.page_id, r.verdict, r.h || r.t AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.t) DESC, length(r.h) DESC) AS k
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.t))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
