"""Audits of raw tables: keys, orphans, overlap between regions, quality gates, schema reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import match_timestamp, semantic_region
from .distinct import one_row, repeated


def key_report(df: DataFrame, keys: list[str], targets: list[str] = (), ts: str | None = None) -> DataFrame:
    """One row: rows, columns, duplicate_rows, duplicate_keys, null_keys, null_timestamps, missing rate per target, complete targets."""
    some = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")]
    more = [F.sum(some.cast("long")).alias("null_keys")]
    if ts:
        more.append(F.sum(F.col(ts).isNull().cast("long")).alias("null_timestamps"))
    more += [F.avg(F.col(t).isNull().cast("double")).alias(f"{t}_missing") for t in targets]
    if targets:
        more.append(F.sum(reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in targets]).cast("long")).alias("complete_targets"))
    # Keys count as before: a key with a null in it is a key.
    parts = [df.agg(*counted), repeated(df, None, "duplicate_rows"), repeated(df, keys, "duplicate_keys"), df.agg(*more)]
    return one_row(parts)


def gate(report: DataFrame, targets: list[str], max_missing: float = 0.05) -> DataFrame:
    """``passed``: no duplicate keys and at least one row with all targets; ``warnings``: targets missing in more than ``max_missing`` of the rows, which don't fail it."""
    often = [(F.col(f"{t}_missing") > max_missing).cast("long") for t in targets]
    return report.withColumns({"warnings": reduce(Column.__add__, often), "passed": (F.col("duplicate_keys") == 0) & (F.col("complete_targets") > 0)})


# The columns that the raw tables must have, and the targets.
RAW_COLUMNS = {
    "matches": ["region", "match_id", "match_url", "event_id", "match_date"],
    "players_stat": ["region", "player_id", "team_id", "agent", "map", "match_id", "rating2_all", "acs_all", "kills_all", "deaths_all"],
    "match_maps_stat": ["region", "match_id", "map_name", "team_1_id", "team_2_id", "team_pick", "map_winner"],
}
RAW_TARGETS = ["rating2_all", "acs_all", "kills_all", "deaths_all"]
RAW_KEYS = {"matches": ["match_id"], "players_stat": ["player_id", "match_id", "map"], "match_maps_stat": ["match_id", "map_name"]}


def gate_findings(tables: dict[str, DataFrame], max_missing: float = 0.05) -> DataFrame:
    """table, finding, level (error or warning), n: what is wrong with the three raw tables, named as in RAW_COLUMNS; no row if nothing is.

    Errors: missing columns, rows without a region, no region at all, repeated keys
    (nulls are equal), ids without a match, no row with all targets. Warnings: a target
    missing in over ``max_missing`` of the rows, dates that can't be read.
    """
    ids = tables["matches"].select(F.col("match_id").cast("string").alias("match_id")).where("match_id is not null").distinct() if "match_id" in tables["matches"].columns else None
    parts = []
    for name, df in tables.items():
        have, rows = set(df.columns), F.count(F.lit(1))
        counted = {("missing_columns", "error"): F.lit(len(set(RAW_COLUMNS[name]) - have)).cast("long")}
        if "region" in have:
            counted[("missing_region", "error")] = rows - F.count("region")
            counted[("no_region", "error")] = (F.count("region") == 0).cast("long")
        if set(RAW_KEYS[name]) <= have:
            counted[("duplicate_keys", "error")] = rows - F.count_distinct(F.struct(*RAW_KEYS[name]))
        if name == "matches" and "match_date" in have:
            counted[("unreadable_dates", "warning")] = rows - F.count(match_timestamp("match_date"))
        if name == "players_stat" and set(RAW_KEYS[name]) <= have:
            value = {t: F.col(t) if t in have else F.lit(None) for t in RAW_TARGETS}
            for t, v in value.items():
                counted[(f"missing_{t}", "warning")] = F.when(F.avg(v.isNull().cast("double")) > max_missing, F.sum(v.isNull().cast("long"))).otherwise(0)
            whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in value.values()])
            counted[("no_complete_targets", "error")] = (F.coalesce(F.sum(whole.cast("long")), F.lit(0)) == 0).cast("long")
        one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counted.values())])
        found = F.array(*[F.struct(F.lit(k[0]).alias("finding"), F.lit(k[1]).alias("level"), F.col(f"c{i}").alias("n")) for i, k in enumerate(counted)])
        parts.append(one.select(F.lit(name).alias("table"), F.explode(found).alias("f")).select("table", "f.*"))
        if name != "matches" and ids is not None and "match_id" in have:
            lost = df.select(F.col("match_id").cast("string").alias("match_id")).where("match_id is not null").join(ids, "match_id", "left_anti")
            parts.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit("orphan_rows").alias("finding"), F.lit("error").alias("level"), "n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def gate_status(findings: DataFrame) -> DataFrame:
    """status, errors, warnings: failed if there is an error."""
    kinds = [F.count(F.when(F.col("level") == k, 1)).alias(f"{k}s") for k in ("error", "warning")]
    return findings.agg(*kinds).select(F.when(F.col("errors") > 0, "failed").otherwise("passed").alias("status"), "errors", "warnings")


def orphan_counts(children: dict[str, DataFrame], parents: DataFrame, key: str) -> DataFrame:
    """table, orphan_rows, orphan_keys: child rows whose key has no parent."""
    parts = []
    for name, c in children.items():
        lost = c.select(key).where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")
        parts.append(lost.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("orphan_rows"), F.count_distinct(key).alias("orphan_keys")))
    return reduce(DataFrame.unionByName, parts)


def overlap(df: DataFrame, key: str, region: str = "region") -> DataFrame:
    """Keys found in more than one region, with the regions."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(region)).alias("regions"))
    return g.where(F.size("regions") > 1)


def shared_events(events: DataFrame, key: str = "event_id", title: str = "title", region: str = "region") -> DataFrame:
    """Events listed by two or more regions under exactly one title."""
    t = F.nullif(F.lower(F.trim(title)), F.lit(""))
    g = events.groupBy(key).agg(F.count_distinct(region).alias("regions"), F.count_distinct(t).alias("titles"))
    return g.where("regions >= 2 and titles = 1").select(key)


def classify_overlap(matches: DataFrame, shared: DataFrame, key: str = "match_id") -> DataFrame:
    """Matches in two or more regions: expected if all rows name one shared event and one URL."""
    g = matches.groupBy(key).agg(
        F.array_sort(F.collect_set("region")).alias("regions"),
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("match_url").alias("urls"),
        F.max("event_id").alias("event_id"),
    )
    g = g.where(F.size("regions") > 1).join(shared.withColumn("_shared", F.lit(True)), "event_id", "left")
    return g.withColumn("expected", F.coalesce("_shared", F.lit(False)) & (F.col("events") == 1) & (F.col("urls") <= 1)).drop("_shared")


def title_report(events: DataFrame, region: str, title: str = "title") -> DataFrame:
    """One row: explicit, unclassified and conflicting titles of a region's events, ten examples (the first in order), whether it is valid."""
    r = semantic_region(title)
    bad = r.isNotNull() & (r != region)
    counts = events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((r == region).cast("long")).alias("explicit_region_matches"),
        F.sum(r.isNull().cast("long")).alias("unclassified_titles"),
        F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias("conflicting_titles"),
    )
    ten = events.where(bad).select(F.col(title).alias("t")).distinct().orderBy("t").limit(10)
    out = one_row([counts, ten.agg(F.array_sort(F.collect_list("t")).alias("examples"))])
    return out.withColumn("valid", (F.col("conflicting_titles") == 0) & ((F.col("rows") == 0) | (F.col("explicit_region_matches") > 0)))


def region_report(df: DataFrame, region: str, keys: list[str]) -> DataFrame:
    """Rows of other regions, and duplicate and null keys, of one region's table."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("region").eqNullSafe(region)).cast("long")).alias("wrong_region"))
    return one_row([counted, repeated(df, keys, "duplicate_keys"), df.agg(F.sum(null.cast("long")).alias("null_keys"))])


#: Of each raw table, columns whose nulls a region's audit reports.
REQUIRED_VALUES = [*RAW_TARGETS, "agent", "team_id"]


def audit_region(region: str, tables: dict[str, DataFrame]) -> DataFrame:
    """table, check, n: what one region's raw tables hold, named as in RAW_COLUMNS, and perhaps events with titles.

    Of each table: rows, duplicate_rows, wrong_region (null counts; missing_region_column 1 if there is none),
    missing_<column> where a column has nulls, and duplicate_keys where its key columns are there.
    Ids of players and maps without a match are orphan_rows. Events with a title are
    also counted by what their titles say.
    """
    ids = None
    if "matches" in tables and "match_id" in tables["matches"].columns:
        ids = tables["matches"].select(F.col("match_id").cast("string").alias("match_id")).where("match_id is not null").distinct()
    parts = []
    for name, df in tables.items():
        counted = {"rows": F.count(F.lit(1))}
        if "region" in df.columns:
            counted["wrong_region"] = F.sum((~F.col("region").cast("string").eqNullSafe(region)).cast("long"))
        else:
            counted["missing_region_column"] = F.lit(1).cast("long")
        counted |= {f"missing_{c}": F.sum(F.col(c).isNull().cast("long")) for c in df.columns}
        if "title" in df.columns:
            r = semantic_region("title")
            counted |= {"explicit_titles": F.sum((r == region).cast("long")), "unclassified_titles": F.sum(r.isNull().cast("long")), "conflicting_titles": F.sum((r != region).cast("long"))}
        rows = [df.agg(*[x.alias(k) for k, x in counted.items()]), repeated(df, None, "duplicate_rows")]
        if name in RAW_KEYS and set(RAW_KEYS[name]) <= set(df.columns):
            rows.append(repeated(df, RAW_KEYS[name], "duplicate_keys"))
        if name != "matches" and ids is not None and "match_id" in df.columns:
            lost = df.select(F.col("match_id").cast("string").alias("match_id")).where("match_id is not null").join(ids, "match_id", "left_anti")
            rows.append(lost.agg(F.count(F.lit(1)).alias("orphan_rows")))
        one = one_row(rows)
        found = one.unpivot([], one.columns, "check", "n").select(F.lit(name).alias("table"), "check", F.coalesce("n", F.lit(0)).alias("n"))
        parts.append(found.where("check not like 'missing\\_%' or n > 0"))
    return reduce(DataFrame.unionByName, parts)


def completed(map_name: Column, winner: Column, targets: list[Column], ts: Column, cutoff: Column | None = None) -> Column:
    """Filter of finished maps strictly before the cutoff (default: the start of tomorrow); ``Draw`` is a winner."""
    cut = F.date_add(F.current_date(), 1).cast("timestamp") if cutoff is None else cutoff
    return reduce(lambda a, b: a & b, [map_name.isNotNull(), winner.isNotNull(), *[t.isNotNull() for t in targets], ts < cut])


def prune_future(matches: DataFrame, children: dict[str, DataFrame], cutoff, date: str = "match_date", key: str = "match_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Matches up to and including the cutoff date, and the child rows that belong to them."""
    day = F.col(date).try_cast("date")
    kept = matches.where(day.isNotNull() & (day <= F.lit(cutoff).cast("date")))
    return kept, {n: c.join(kept.select(key), key, "left_semi") for n, c in children.items()}
