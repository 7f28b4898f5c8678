"""Queries of cleaning, dedup, joins, audits, profiles, views, splits and metrics, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as c
from ..operators import audit, dedup, fuzzy, joins, metrics, profile, splits, views
from ..operators.graph import shared_folder
from ..sources import tables
from .fact import fact, table, with_fact

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["player_id", "match_id", "map"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- sources ------------------------------------------------------------------


@query("io2_only_columns", "SELECT o_orderkey, o_custkey FROM orders")
def io2(spark, d):
    return tables.only_columns(table(spark, d, "orders"), ["o_custkey", "o_orderkey", "not_there"])


@query("io3_preferred_source", "SELECT n_nationkey, n_name FROM nation")
def io3(spark, d):
    return tables.read_preferred(spark, f"{d}/none.parquet", f"{d}/nation.parquet").select("n_nationkey", "n_name")


@query("io4_merge_regions", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment, 'a' AS region FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'b' FROM customer")
def io4(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tables.merge_regions({"a": a, "b": b})


@query("io6_not_loaded", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def io6(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.not_loaded(table(spark, d, "orders"), lines, "o_orderkey").select("o_orderkey")


# --- expressions ----------------------------------------------------------------


@query("p1_to_number", "SELECT event_id, try_cast(regexp_extract(props, '\\d+') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number FROM events")
def p1(spark, d):
    return table(spark, d, "events").select("event_id", c.to_number(F.regexp_extract("props", r"\d+", 0)).alias("k"), c.to_number("event_type").alias("not_a_number"))


@query("p2_percent", "SELECT l_orderkey, l_linenumber, l_discount AS d, round(l_discount * 100)::INT / 100 AS fraction, round(l_discount * 100)::INT::DOUBLE AS number FROM lineitem")
def p2(spark, d):
    text = F.concat(F.lit(" "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% "))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("d"), c.percent(text).alias("fraction"), c.percent(text, False).alias("number"))


@query("p3_ratio", "SELECT l_orderkey, l_linenumber, l_quantity / nullif(round(l_tax * 100), 0) AS ratio FROM lineitem")
def p3(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.ratio(F.col("l_quantity"), F.round(F.col("l_tax") * 100)).alias("ratio"))


@query("p4_timestamp", "SELECT event_id, date_trunc('second', ts) AS both, date_trunc('day', ts) AS day FROM events")
def p4(spark, d):
    e = table(spark, d, "events").withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "time": F.date_format("ts", "HH:mm:ss")})
    return e.select("event_id", c.match_timestamp("day", "time").cast("timestamp_ntz").alias("both"), c.match_timestamp("day", F.lit("late")).cast("timestamp_ntz").alias("day"))


@query("p6_key_text", "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g') AS k FROM part")
def p6(spark, d):
    return table(spark, d, "part").select("p_partkey", c.key_text("p_name").alias("k"))


@query("p7_roles", with_fact("SELECT player_id, match_id, map, role, role_confidence FROM fact"))
def p7(spark, d):
    return fact(spark, d).select(*KEY, "role", "role_confidence")


@query("p9_complete_rows", with_fact("SELECT player_id, match_id, map FROM fact WHERE rating IS NOT NULL AND acs IS NOT NULL AND kda IS NOT NULL"))
def p9(spark, d):
    return fact(spark, d).dropna(subset=["rating", "acs", "kda"]).select(KEY)


@query("p10_known_text", "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events")
def p10(spark, d):
    text = F.when(F.col("event_type") == "error", F.lit(" TBD ")).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return table(spark, d, "events").select("event_id", c.known_text(text).alias("kind"))


@query("p11_region_of_title", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'CHINA' WHEN 1 THEN 'EMEA' WHEN 2 THEN 'AMERICAS' WHEN 3 THEN 'PACIFIC' END AS region FROM nation")
def p11(spark, d):
    words = F.element_at(F.array(*map(F.lit, ["EMEA in China", "Open of Europe", "LATAM Cup", "SEA finals", "Season of oceanias"])), F.col("n_nationkey") % 5 + 1)
    return table(spark, d, "nation").select("n_nationkey", c.semantic_region(F.concat(words, F.lit(" "), "n_name")).alias("region"))


@query("p12_id_from_url", r"SELECT page_id, nullif(regexp_extract(url, '/(?:en|de|fr|es)/(\d+)', 1), '') AS id, (regexp_extract(url, '/en/(\d+)(?:/|$)', 1)) AS strict_en FROM pages")
def p12(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"/(?:en|de|fr|es)/(\d+)", 1), F.lit("")).alias("id"), F.coalesce(c.id_from_url("url", "en"), F.lit("")).alias("strict_en"))


@query("p13_event_dates", "SELECT o_orderkey, o_orderdate::DATE AS start_date, date_trunc('month', o_orderdate)::DATE + 27 AS end_date FROM orders")
def p13(spark, d):
    raw = F.concat(F.lower(F.date_format("o_orderdate", "MMM d")), F.lit(" - "), F.lit("28"), F.date_format("o_orderdate", ", yyyy"))
    return table(spark, d, "orders").select("o_orderkey", *[x.alias(n) for n, x in c.event_dates(raw).items()])


ROUNDS = "sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END)"


@query(
    "p14_winner_p15_score",
    "SELECT l_orderkey, CASE WHEN coalesce(a, 0) > coalesce(b, 0) THEN 'even' WHEN coalesce(b, 0) > coalesce(a, 0) THEN 'odd' ELSE 'Draw' END AS winner, 'CT/T ' || coalesce(a, 0)::BIGINT || '-' || coalesce(b, 0)::BIGINT AS score"
    " FROM (SELECT l_orderkey, sum(l_quantity) FILTER (l_linenumber % 2 = 0) AS a, sum(l_quantity) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY 1)",
)
def p14(spark, d):
    part = lambda k: F.sum(F.when(F.col("l_linenumber") % 2 == k, F.col("l_quantity")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(part(0).alias("a"), part(1).alias("b"))
    return g.select("l_orderkey", c.winner([F.col("a")], [F.col("b")], F.lit("even"), F.lit("odd")).alias("winner"), c.round_score([F.col("a")], [F.col("b")]).alias("score"))


CUT = "1999-01-01"


@query("p16_completed_history", with_fact(f"SELECT player_id, match_id, map FROM fact WHERE rating IS NOT NULL AND acs IS NOT NULL AND kda IS NOT NULL AND map_winner IS NOT NULL AND ts < TIMESTAMP '{CUT}'"))
def p16(spark, d):
    f = fact(spark, d)
    return f.where(audit.completed(F.col("map"), F.col("map_winner"), [F.col(x) for x in ("rating", "acs", "kda")], F.col("ts"), F.lit(CUT).cast("timestamp"))).select(KEY)


@query("p17_prune_future", f"SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate::DATE <= DATE '{CUT}' GROUP BY 1")
def p17(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("string").substr(1, 10).alias("match_date"))
    _, kept = audit.prune_future(orders, {"lines": table(spark, d, "lineitem")}, CUT, key="l_orderkey")
    return kept["lines"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("p18_team_filter_t3_history", with_fact("SELECT player_id, match_id, map, rating FROM fact WHERE team_id = 7 AND player_id = 3"))
def p18(spark, d):
    return views.player_history(views.of_team(fact(spark, d), 7), 3).select(*KEY, "rating")


@query("p19_search", "SELECT p_partkey FROM part WHERE contains(lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')), 'red w')")
def p19(spark, d):
    return table(spark, d, "part").where(F.contains(c.search_text("p_name"), c.search_text(F.lit(" Red   W")))).select("p_partkey")


@query("p20_fuzzy_names")
def p20(spark, d):
    return fuzzy.close_names(["customer 17", "Custmer#000000042", "HOUSE"], table(spark, d, "customer"), 3, name="c_name").withColumn("score", F.round("score", 6))


BUCKET = "CASE WHEN n <= 0 THEN 'cold_start' WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END"


@query("p21_experience", f"SELECT c_custkey, {BUCKET} AS bucket, n > 0 AS known FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def p21(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", c.experience_bucket("n").alias("bucket"), (F.col("n") > 0).alias("known"))


@query("p23_low_confidence", f"SELECT c_custkey, n < 5 AS low_confidence, CASE WHEN n < 5 THEN 'Low confidence: limited player history or cold start' ELSE 'Use as estimated performance, not a win probability' END AS confidence_warning FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def p23(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", *[x.alias(k) for k, x in c.low_confidence((F.col("n") == 0).cast("int"), "n").items()])


@query("p24_fill_unknown", with_fact("SELECT player_id, match_id, map, coalesce(CASE WHEN map_winner <> 'Draw' THEN map_winner END, '__unknown__') AS map_winner, '__unknown__' AS patch, 0.5::DOUBLE AS match_importance FROM fact"))
def p24(spark, d):
    f = fact(spark, d).withColumn("map_winner", F.when(F.col("map_winner") != "Draw", F.col("map_winner")))
    return c.fill_unknown(f, ["map_winner", "patch"]).select(*KEY, "map_winner", "patch", "match_importance")


@query("p25_labels", "SELECT s_suppkey, s_name || ' (' || n_name || ') · id=' || s_suppkey AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p25(spark, d):
    j = joins.many_to_one(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(spark, d, "nation"), ["n_nationkey"])
    return j.select("s_suppkey", c.display_label("s_name", "n_name", "s_suppkey").alias("label"))


# --- dedup and joins ------------------------------------------------------------

D = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
DORDER = [x.strip() for x in D.split(",")]


@query("d1_keep_last", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(x + ' DESC' for x in DORDER)}) = 1")
def d1(spark, d):
    return dedup.keep_last(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], DORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("d2_keep_first_source", f"SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, {D}) = 1")
def d2(spark, d):
    return dedup.keep_first_source(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag", DORDER).select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")


@query("d3_keep_any", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def d3(spark, d):
    return dedup.keep_any(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("d4_latest_per_entity", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def d4(spark, d):
    return dedup.latest_per(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("j1_many_to_one", "SELECT l_orderkey, l_linenumber, o_custkey, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def j1(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return joins.many_to_one(table(spark, d, "lineitem"), o, ["l_orderkey"]).groupBy("l_orderkey", "l_linenumber", "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("j4_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j4(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.only_known(table(spark, d, "orders"), r, ["o_orderkey"]).select("o_orderkey")


@query("j5_orphans", "SELECT 'customer' AS \"table\", count(*) AS orphan_rows, count(DISTINCT c_custkey) AS orphan_keys FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j5(spark, d):
    return audit.orphan_counts({"customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "k")}, table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k")


@query("j6_opponent_side", with_fact("SELECT player_id, match_id, map, opponent_team_id AS other FROM fact"))
def j6(spark, d):
    return fact(spark, d).select(*KEY, F.when(F.col("team_1_id") == F.col("team_2_id"), F.col("opponent_team_id")).otherwise(joins.other_side("team_id", "team_1_id", F.col("team_1_id"), F.col("team_2_id"))).alias("other"))


@query(
    "j11_as_of",
    "SELECT o.o_orderkey, p.o_orderkey AS last_urgent, p.o_totalprice AS last_price FROM orders o LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders u WHERE u.o_custkey = o.o_custkey AND u.o_orderpriority = '1-URGENT' AND u.o_orderdate < o.o_orderdate ORDER BY u.o_orderdate DESC, u.o_orderkey DESC LIMIT 1) p ON true",
)
def j11(spark, d):
    o = table(spark, d, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_urgent"), F.col("o_totalprice").alias("last_price"))
    return joins.as_of(o.select("o_orderkey", "o_custkey", "o_orderdate"), urgent, "o_custkey", "o_orderdate", ["last_urgent", "last_price"], ["last_urgent"]).select("o_orderkey", "last_urgent", "last_price")


# --- audits and profiles --------------------------------------------------------


@query("a2_overlap", "SELECT l_partkey, list_sort(list(DISTINCT l_returnflag))::VARCHAR AS regions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def a2(spark, d):
    o = audit.overlap(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "region"), "l_partkey")
    return o.select("l_partkey", F.concat(F.lit("["), F.array_join("regions", ", "), F.lit("]")).alias("regions"))


@query("a3_shared_events", "SELECT o_custkey AS event_id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2 AND count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'open' ELSE lower(o_orderstatus) END) = 1")
def a3(spark, d):
    title = F.when(F.col("o_custkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, " Open ").otherwise("OPEN")).otherwise(F.col("o_orderstatus"))
    return audit.shared_events(table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), title.alias("title"), F.col("o_orderpriority").alias("region")))


@query(
    "a4_expected_overlap",
    "WITH g AS (SELECT l_orderkey AS match_id, count(DISTINCT l_linestatus) AS e, max(l_linestatus) AS ev, count(DISTINCT l_linenumber) AS u FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1) SELECT match_id, (ev = 'F' AND e = 1 AND u <= 1) AS expected FROM g",
)
def a4(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("event_id"), F.col("l_linenumber").alias("match_url"))
    shared = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_linestatus").alias("event_id")).distinct()
    return audit.classify_overlap(m, shared).select("match_id", "expected")


@query(
    "a5_quality_gate",
    with_fact(
        "SELECT count(*) AS rows, count(*) - count(DISTINCT (player_id, match_id, map)) AS duplicate_keys, sum((player_id IS NULL OR match_id IS NULL OR map IS NULL)::INT)::BIGINT AS null_keys, sum((ts IS NULL)::INT)::BIGINT AS null_timestamps, avg((rating IS NULL)::INT) AS rating_missing, avg((kda IS NULL)::INT) AS kda_missing, sum((rating IS NOT NULL AND kda IS NOT NULL)::INT)::BIGINT AS complete_targets, ((avg((rating IS NULL)::INT) > 0.05)::INT + (avg((kda IS NULL)::INT) > 0.05)::INT)::BIGINT AS warnings, count(*) = count(DISTINCT (player_id, match_id, map)) AND sum((rating IS NOT NULL AND kda IS NOT NULL)::INT) > 0 AS passed FROM fact"
    ),
)
def a5(spark, d):
    r = audit.key_report(fact(spark, d), KEY, ["rating", "kda"], "ts")
    return audit.gate(r, ["rating", "kda"]).drop("columns", "duplicate_rows")


@query("a6_region_report", "SELECT count(*) AS rows, sum((l_returnflag <> 'R')::INT)::BIGINT AS wrong_region, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys, 0::BIGINT AS null_keys FROM lineitem")
def a6(spark, d):
    return audit.region_report(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "region"), "R", ["l_orderkey", "l_linenumber"])


@query(
    "a6_region_audit",
    """WITH m AS (SELECT o_orderkey AS match_id, CASE WHEN o_custkey % 10 <> 3 THEN 'EMEA' WHEN o_custkey % 20 = 3 THEN 'Pacific' END AS region, nullif(o_orderpriority, '1-URGENT') AS match_url FROM orders WHERE o_orderkey % 40 <> 7),
p AS (SELECT l_suppkey AS player_id, l_orderkey AS match_id, 'map' || (l_linenumber % 3) AS map, 'EMEA' AS region, nullif(l_quantity, 50) AS rating2_all, CASE WHEN l_discount <> 0 THEN l_extendedprice END AS acs_all, l_returnflag AS agent FROM lineitem),
t AS (SELECT l_orderkey AS match_id, 'map' || (l_linenumber % 3) AS map_name, l_linestatus AS map_winner FROM lineitem),
e AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'Champions EMEA ' || n_name WHEN 1 THEN 'Champions Japan ' || n_name ELSE 'x ' || n_name END AS title, 'EMEA' AS region FROM nation),
f AS (SELECT 'matches' AS "table", 'rows' AS "check", count(*) AS n FROM m
UNION ALL SELECT 'matches', 'wrong_region', count(*) FILTER (region IS DISTINCT FROM 'EMEA') FROM m
UNION ALL SELECT 'matches', 'missing_region', count(*) - count(region) FROM m UNION ALL SELECT 'matches', 'missing_match_url', count(*) - count(match_url) FROM m
UNION ALL SELECT 'matches', 'duplicate_rows', (SELECT count(*) FROM m) - (SELECT count(*) FROM (SELECT DISTINCT * FROM m))
UNION ALL SELECT 'matches', 'duplicate_keys', count(*) - count(DISTINCT match_id) FROM m
UNION ALL SELECT 'players_stat', 'rows', count(*) FROM p UNION ALL SELECT 'players_stat', 'wrong_region', 0
UNION ALL SELECT 'players_stat', 'missing_rating2_all', count(*) - count(rating2_all) FROM p UNION ALL SELECT 'players_stat', 'missing_acs_all', count(*) - count(acs_all) FROM p
UNION ALL SELECT 'players_stat', 'duplicate_rows', (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p))
UNION ALL SELECT 'players_stat', 'duplicate_keys', count(*) - count(DISTINCT (player_id, match_id, map)) FROM p
UNION ALL SELECT 'players_stat', 'orphan_rows', count(*) FROM p WHERE match_id NOT IN (SELECT match_id FROM m)
UNION ALL SELECT 'match_maps_stat', 'rows', count(*) FROM t UNION ALL SELECT 'match_maps_stat', 'missing_region_column', 1
UNION ALL SELECT 'match_maps_stat', 'duplicate_rows', (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))
UNION ALL SELECT 'match_maps_stat', 'duplicate_keys', count(*) - count(DISTINCT (match_id, map_name)) FROM t
UNION ALL SELECT 'match_maps_stat', 'orphan_rows', count(*) FROM t WHERE match_id NOT IN (SELECT match_id FROM m)
UNION ALL SELECT 'events', 'rows', count(*) FROM e UNION ALL SELECT 'events', 'wrong_region', 0 UNION ALL SELECT 'events', 'duplicate_rows', count(*) - count(DISTINCT title) FROM e
UNION ALL SELECT 'events', 'explicit_titles', count(*) FILTER (title LIKE '%EMEA%') FROM e UNION ALL SELECT 'events', 'unclassified_titles', count(*) FILTER (title LIKE 'x %') FROM e
UNION ALL SELECT 'events', 'conflicting_titles', count(*) FILTER (title LIKE '%Japan%') FROM e)
SELECT "table", "check", n::BIGINT AS n FROM f WHERE "check" NOT IN ('missing_region', 'missing_match_url', 'missing_rating2_all', 'missing_acs_all') OR n > 0""",
)
def a6_audit(spark, d):
    lines = table(spark, d, "lineitem").withColumn("map", F.expr("concat('map', l_linenumber % 3)"))
    matches = table(spark, d, "orders").where("o_orderkey % 40 <> 7").selectExpr("o_orderkey AS match_id", "CASE WHEN o_custkey % 10 <> 3 THEN 'EMEA' WHEN o_custkey % 20 = 3 THEN 'Pacific' END AS region", "nullif(o_orderpriority, '1-URGENT') AS match_url")
    players = lines.selectExpr("l_suppkey AS player_id", "l_orderkey AS match_id", "map", "'EMEA' AS region", "nullif(l_quantity, 50.0D) AS rating2_all", "CASE WHEN l_discount <> 0 THEN l_extendedprice END AS acs_all", "l_returnflag AS agent")
    maps = lines.selectExpr("l_orderkey AS match_id", "map AS map_name", "l_linestatus AS map_winner")
    events = table(spark, d, "nation").selectExpr("CASE n_nationkey % 3 WHEN 0 THEN concat('Champions EMEA ', n_name) WHEN 1 THEN concat('Champions Japan ', n_name) ELSE concat('x ', n_name) END AS title", "'EMEA' AS region")
    return audit.audit_region("EMEA", {"matches": matches, "players_stat": players, "match_maps_stat": maps, "events": events})


@query("io1_csv_io5_write", "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders")
def io1(spark, d):
    """Orders written as CSV by status, and read again with their schema."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    tables.write(rows, path, "csv", by=["o_orderstatus"])
    return tables.read(spark, path, "csv", "o_orderkey bigint, o_orderpriority string, o_totalprice double, o_orderstatus string")


@query(
    "t5_shortlist",
    with_fact(
        "SELECT target, model, mae, mae_std, n, row_number() OVER (PARTITION BY target ORDER BY mae, mae_std, model) = 1 AS chosen FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY mae, model) <= 2)",
        "s AS (SELECT role AS target, agent || map AS model, round(avg(abs(rating - 25)), 6) AS mae, round(stddev_pop(rating), 6) AS mae_std, count(*) AS n FROM fact GROUP BY ALL)",
    ),
)
def t5(spark, d):
    """Of each role the two agents and maps whose ratings lie nearest 25, and the one chosen."""
    f = fact(spark, d)
    scores = f.groupBy(F.col("role").alias("target"), F.concat("agent", "map").alias("model")).agg(F.round(F.avg(F.abs(F.col("rating") - 25)), 6).alias("mae"), F.round(F.stddev_pop("rating"), 6).alias("mae_std"), F.count(F.lit(1)).alias("n"))
    return views.shortlist(scores)


@query(
    "t10_next_requests_d4",
    with_fact("SELECT player_id, '__inference_' || player_id AS match_id, map, team_id, opponent_team_id, agent, role FROM fact QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, match_id DESC, map DESC) = 1"),
)
def t10_next(spark, d):
    """A request for every player's next map."""
    return views.next_requests(fact(spark, d), "2030-01-01 00:00:00").select("player_id", "match_id", "map", "team_id", "opponent_team_id", "agent", "role")


@query("a7_title_report", "SELECT count(*) AS rows, sum((n_nationkey % 5 = 1)::INT)::BIGINT AS explicit_region_matches, sum((n_nationkey % 5 > 1)::INT)::BIGINT AS unclassified_titles, sum((n_nationkey % 5 = 0)::INT)::BIGINT AS conflicting_titles, sum((n_nationkey % 5 = 0)::INT) = 0 AS valid FROM nation")
def a7(spark, d):
    words = F.element_at(F.array(*map(F.lit, ["Japan", "EMEA", "x", "Masters", "Champions"])), F.col("n_nationkey") % 5 + 1)
    return audit.title_report(table(spark, d, "nation").withColumn("title", F.concat(words, F.lit(" "), "n_name")), "EMEA").drop("examples")


@query("a8_schema_report_a13_duplicates", "SELECT count(*) AS rows, 3::BIGINT AS columns, count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_returnflag)) AS duplicate_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys, 0::BIGINT AS null_keys FROM lineitem")
def a8(spark, d):
    return audit.key_report(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"])


@query(
    "a9_fill_by_role",
    with_fact("SELECT player_id, match_id, map, coalesce(f1, avg(f1) OVER ()) AS rating FROM (SELECT player_id, match_id, map, coalesce(rating, avg(rating) OVER (PARTITION BY role)) AS f1 FROM fact)"),
)
def a9(spark, d):
    return profile.fill_by_role(fact(spark, d), ["rating"]).select(*KEY, "rating")


@query("a10_by_category", with_fact("SELECT agent, count(rating) AS count, avg(rating) AS mean, median(rating) AS median FROM fact GROUP BY 1"))
def a10(spark, d):
    return profile.by_category(fact(spark, d), "agent", "rating")


NUMS = ["rating", "acs", "kda"]


@query("a11_describe", with_fact(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", count({x}) AS count, avg({x}) AS mean, round(stddev_samp({x}), 4) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS max FROM fact" for x in NUMS)))
def a11(spark, d):
    return profile.describe_numeric(fact(spark, d), NUMS).withColumn("std", F.round("std", 4))


@query(
    "a12_describe_categories",
    with_fact(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) + max(({x} IS NULL)::INT) AS distinct, (SELECT {x} FROM fact WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, (SELECT count(*) FROM fact WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC LIMIT 1) AS mode_count FROM fact" for x in ("agent", "map", "map_winner"))),
)
def a12(spark, d):
    return profile.describe_categories(fact(spark, d), ["agent", "map", "map_winner"])


@query("a14_null_counts", with_fact(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", sum(({x} IS NULL)::INT)::BIGINT AS missing, sum(({x} IS NULL)::INT) * 100.0::DOUBLE / count(*) AS percent FROM fact" for x in NUMS)))
def a14(spark, d):
    return profile.null_counts(fact(spark, d).select(NUMS))


@query("a15_nulls_per_row", with_fact("SELECT (rating IS NULL)::INT + (acs IS NULL)::INT + (kda IS NULL)::INT AS missing_columns, count(*) AS rows FROM fact GROUP BY 1"))
def a15(spark, d):
    return profile.nulls_per_row(fact(spark, d).select(NUMS))


@query("a16_drop_strategies", with_fact("SELECT 'drop_rows' AS strategy, count(*) FILTER (rating IS NOT NULL AND acs IS NOT NULL AND kda IS NOT NULL) AS rows, 4::BIGINT AS columns, count(*) FILTER (rating IS NOT NULL AND acs IS NOT NULL AND kda IS NOT NULL) * 100.0::DOUBLE / count(*) AS kept_percent FROM fact UNION ALL SELECT 'drop_columns', count(*), 1, 100.0 FROM fact"))
def a16(spark, d):
    return profile.drop_strategies(fact(spark, d).select(*NUMS, "map"))


@query("a17_null_patterns", with_fact("SELECT p AS pattern, count(*) AS rows, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM (SELECT concat_ws(' | ', CASE WHEN rating IS NULL THEN 'rating' END, CASE WHEN acs IS NULL THEN 'acs' END, CASE WHEN kda IS NULL THEN 'kda' END) AS p FROM fact) WHERE p <> '' GROUP BY 1"))
def a17(spark, d):
    return profile.null_patterns(fact(spark, d).select(NUMS))


@query("a19_null_cluster", with_fact("SELECT *, rows - all_null AS left_without_all_null, rows - any_null AS left_without_any_null FROM (SELECT count(*) AS rows, count(*) FILTER (rating IS NULL AND acs IS NULL) AS all_null, count(*) FILTER (rating IS NULL OR acs IS NULL) AS any_null FROM fact)"))
def a19(spark, d):
    return profile.null_cluster(fact(spark, d), ["rating", "acs"])


@query("a20_correlations", with_fact("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM fact" for a in NUMS for b in NUMS) + ")"))
def a20(spark, d):
    return profile.correlations(fact(spark, d), NUMS).withColumn("r", F.round("r", 4))


@query("a20_target_ranking", with_fact("SELECT 'acs' AS \"column\", round(corr(acs, rating), 4) AS r FROM fact UNION ALL SELECT 'kda', round(corr(kda, rating), 4) FROM fact"))
def a20b(spark, d):
    return profile.target_ranking(fact(spark, d), ["acs", "kda"], "rating").withColumn("r", F.round("r", 4))


@query("a21_top_entities", "SELECT user_id, count(*) AS rows, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a21(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_type").alias("kinds"))
    return g.orderBy(F.col("rows").desc(), "user_id").limit(10)


@query("a22_active_years", with_fact("SELECT years, count(*) AS entities FROM (SELECT player_id, count(DISTINCT year(ts)) AS years FROM fact GROUP BY 1) GROUP BY 1"))
def a22(spark, d):
    return profile.active_years(fact(spark, d), "player_id", "ts")


@query(
    "a23_box_stats",
    with_fact(
        "SELECT agent, q1, q2, q3, min(rating) AS low, max(rating) AS high FROM (SELECT f.agent, f.rating, q.q1, q.q2, q.q3 FROM fact f JOIN q USING (agent)) WHERE rating BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL",
        "q AS (SELECT agent, quantile_cont(rating, 0.25) AS q1, quantile_cont(rating, 0.5) AS q2, quantile_cont(rating, 0.75) AS q3 FROM fact GROUP BY 1)",
    ),
)
def a23(spark, d):
    return profile.box_stats(fact(spark, d), "agent", "rating")


@query("a23_histogram", with_fact("SELECT least(floor((rating - lo) * 30 / (hi - lo)) + 1, 30)::BIGINT AS bin, count(*) AS count FROM fact, (SELECT min(rating) AS lo, max(rating) AS hi FROM fact) WHERE rating IS NOT NULL GROUP BY 1"))
def a23b(spark, d):
    return profile.histogram(fact(spark, d), "rating")


# --- views ------------------------------------------------------------------------

MAPS_DESC = "ts DESC, match_id DESC, map DESC"


@query("a24_map_history", with_fact("SELECT match_id, map, min(ts)::DATE AS day, arg_min(acs, (ts, player_id)) FILTER (acs IS NOT NULL) AS acs, arg_min(agent, (ts, player_id)) AS agent FROM fact GROUP BY 1, 2"))
def a24(spark, d):
    return views.map_history(fact(spark, d), ["acs", "agent"], ["ts", "player_id"]).select("match_id", "map", F.to_date("ts").alias("day"), "acs", "agent")


@query(
    "a25_match_trend",
    with_fact(
        "SELECT player_id, match_id, rating, acs, maps, row_number() OVER (PARTITION BY player_id ORDER BY ts, match_id) AS place FROM (SELECT player_id, match_id, min(ts) AS ts, avg(rating) AS rating, avg(acs) AS acs, array_to_string(list_sort(list(DISTINCT map)), ', ') AS maps FROM fact GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, match_id DESC) <= 10"
    ).replace("row_number() OVER (PARTITION BY player_id ORDER BY ts, match_id) AS place FROM", "0 AS place FROM").replace("SELECT player_id, match_id, rating, acs, maps, 0 AS place", "SELECT player_id, match_id, rating, acs, maps, 11 - least(10, row_number() OVER (PARTITION BY player_id ORDER BY ts DESC, match_id DESC)) - greatest(0, 10 - count(*) OVER (PARTITION BY player_id)) AS place"),
)
def a25(spark, d):
    return views.match_trend(fact(spark, d), ["player_id"], ["rating", "acs"]).select("player_id", "match_id", "rating", "acs", "maps", "place")


LAST5 = "k AS (SELECT team_id, match_id, map, min(ts) AS ts FROM fact GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY min(ts) DESC, match_id DESC, map DESC) <= 5)"


@query(
    "t1_recent_roster_a26_agents",
    with_fact(
        "SELECT team_id, player_id, count(DISTINCT match_id) AS maps_in_window, arg_max(agent, (ts, match_id, -ascii(right(map, 1)))) AS agent, (SELECT string_agg(a, ' / ' ORDER BY i) FROM (SELECT a, min(i) AS i FROM (SELECT unnest(l) AS a, generate_subscripts(l, 1) AS i) GROUP BY a)) AS recent_agents"
        " FROM (SELECT *, list(agent) OVER (PARTITION BY team_id, player_id ORDER BY ts DESC, match_id DESC, map ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM fact JOIN (SELECT team_id, match_id, map FROM k) USING (team_id, match_id, map)) GROUP BY team_id, player_id, l",
        LAST5,
    ),
)
def t1(spark, d):
    return views.recent_roster(fact(spark, d)).select("team_id", "player_id", "maps_in_window", "agent", "recent_agents")


@query("j8_latest_map_rows", with_fact("SELECT player_id, match_id, map FROM fact JOIN (SELECT team_id, match_id, map FROM k) USING (team_id, match_id, map)", LAST5))
def j8(spark, d):
    return views.latest_maps(fact(spark, d), ["team_id"]).select(KEY)


@query("t2_map_keys", with_fact("SELECT match_id, map, min(ts)::DATE AS day FROM fact GROUP BY 1, 2"))
def t2(spark, d):
    return views.map_keys(fact(spark, d)).select("match_id", "map", F.to_date("ts").alias("day"))


@query("t4_team_results", with_fact("SELECT team_id, match_id, map, n, map_winner = team AS won FROM (SELECT team_id, match_id, map, min(team) AS team, min(map_winner) AS map_winner, row_number() OVER (PARTITION BY team_id ORDER BY min(ts) DESC, match_id DESC, map DESC) AS n FROM fact GROUP BY 1, 2, 3) WHERE n <= 10"))
def t4(spark, d):
    return views.team_results(fact(spark, d)).select("team_id", "match_id", "map", "n", "won")


@query("a27_team_catalog", with_fact("SELECT team_id, team, team || ' · id=' || team_id AS display_name FROM (SELECT DISTINCT team_id, team FROM fact)"))
def a27(spark, d):
    return views.team_catalog(fact(spark, d))


@query("a28_opponents", with_fact("SELECT team_id, opponent_team_id, min(opponent_team) AS opponent_team, count(DISTINCT (match_id, map)) AS maps FROM fact GROUP BY 1, 2"))
def a28(spark, d):
    return views.opponents(fact(spark, d))


@query("a29_recent_means", with_fact(f"SELECT player_id, avg(rating) AS rating, avg(kda) AS kda, count(*) AS maps FROM (SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY {MAPS_DESC}) <= 10) GROUP BY 1"))
def a29(spark, d):
    return views.recent_means(fact(spark, d), "player_id", ["rating", "kda"])


@query("a31_train_constants", with_fact("SELECT DISTINCT f.player_id, c.m AS train_mean, c.d AS train_median FROM fact f, (SELECT avg(rating) AS m, median(rating) AS d FROM fact WHERE ts < TIMESTAMP '1999-01-01') c"))
def a31(spark, d):
    f = fact(spark, d)
    return metrics.with_constants(f.select("player_id").distinct(), f.where(F.col("ts") < F.lit(CUT).cast("timestamp")), "rating")


@query("t8_chart_rows_a32_pivot", with_fact("SELECT map, avg(rating) AS rating, avg(kda) AS kda FROM fact GROUP BY 1"))
def t8(spark, d):
    return views.chart_pivot(views.chart_rows(fact(spark, d), KEY, ["rating", "kda"]), "map", ["rating", "kda"])


@query("t7_set_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def t7(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")))


@query("t9_hashed_sample")
def t9(spark, d):
    return views.hashed_sample(fact(spark, d), KEY, 500).select(*KEY, "rating")


@query("w30_fill_tags", "WITH r AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem GROUP BY 1, 2),"
    " t AS (SELECT *, last_value(CASE WHEN p % 3 = 1 THEN 'x' WHEN p % 3 = 2 THEN 'y' END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS tag FROM r),"
    " f AS (SELECT l_orderkey, tag, min(l_linenumber) AS s FROM t WHERE tag IS NOT NULL GROUP BY 1, 2), k AS (SELECT l_orderkey, tag, row_number() OVER (PARTITION BY l_orderkey ORDER BY s) AS rk, count(*) OVER (PARTITION BY l_orderkey) AS tags FROM f),"
    " g AS (SELECT l_orderkey, max(tags) AS tags FROM k GROUP BY 1)"
    " SELECT t.l_orderkey, t.l_linenumber, CASE WHEN k.rk = 1 THEN 'one' WHEN k.rk = 2 THEN 'two' WHEN g.tags = 1 THEN 'one' WHEN t.n <= ceil(t.c / 2.0) THEN 'one' ELSE 'two' END AS assigned_id FROM t LEFT JOIN k ON k.l_orderkey = t.l_orderkey AND k.tag = t.tag LEFT JOIN g ON g.l_orderkey = t.l_orderkey")  # fmt: skip
def w30(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    tag = F.element_at(F.array(F.lit(""), F.lit("x"), F.lit("y")), (F.col("p") % 3 + 1).cast("int"))
    r = r.withColumns({"tag": tag, "id1": F.lit("one"), "id2": F.lit("two")})
    return views.fill_tags(r, ["l_orderkey"], "l_linenumber", "tag", ["id1", "id2"]).select("l_orderkey", "l_linenumber", "assigned_id")


# --- splits and metrics -------------------------------------------------------------

ORDERED = "m AS (SELECT match_id, row_number() OVER (ORDER BY min(ts), match_id) - 1 AS idx, count(*) OVER () AS n FROM fact GROUP BY 1)"


@query("m1_chronological_split", with_fact("SELECT match_id, idx AS match_idx, CASE WHEN idx < floor(n * 0.7) THEN 'train' WHEN idx < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM m", ORDERED))
def m1(spark, d):
    return splits.chronological_split(fact(spark, d)).select("match_id", "match_idx", "split").distinct()


@query(
    "m2_rolling_windows",
    with_fact(
        'SELECT w AS "window", count(*) FILTER (idx < s) AS train, count(*) FILTER (idx >= s AND idx < s + h) AS validation FROM m, (SELECT i AS w, floor(floor(n * 0.45) + (floor(n * 0.85) - floor(n * 0.1) - floor(n * 0.45)) * i / 2) AS s, floor(n * 0.1) AS h FROM (SELECT max(n) AS n FROM m), range(3) t(i)) GROUP BY 1',
        ORDERED,
    ),
)
def m2(spark, d):
    parts = [a.select("match_id").distinct().agg(F.lit(i).cast("long").alias("window"), F.count(F.lit(1)).alias("train")).join(b.select("match_id").distinct().agg(F.count(F.lit(1)).alias("validation"))) for i, (a, b) in enumerate(splits.rolling_splits(fact(spark, d)))]
    return views.union_all(parts)


def _scored(spark, d) -> DataFrame:
    """Rating against the mean of the player's earlier ratings."""
    w = Window.partitionBy("player_id").orderBy("ts", "match_id", "map").rowsBetween(Window.unboundedPreceding, -1)
    return fact(spark, d).select(*KEY, "agent", F.col("rating").alias("actual"), F.avg("rating").over(w).alias("prediction"))


SCORED = "s AS (SELECT agent, rating AS y, avg(rating) OVER (PARTITION BY player_id ORDER BY ts, match_id, map ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fact), v AS (SELECT * FROM s WHERE y IS NOT NULL AND p IS NOT NULL)"
METRIC = "count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2, round(corr(ry, rp), 4) AS spearman"
_avg_rank = lambda x, by="": f"rank() OVER ({by} ORDER BY {x}) + (count(*) OVER ({'PARTITION BY agent, ' if by else 'PARTITION BY '}{x}) - 1) / 2.0"
ROUND4 = ["mae", "rmse", "r2", "spearman"]


@query("m11_metrics", with_fact(f"SELECT {METRIC} FROM (SELECT *, {_avg_rank('y')} AS ry, {_avg_rank('p')} AS rp FROM v)", SCORED))
def m11(spark, d):
    return metrics.metrics(_scored(spark, d)).select("n", *[F.round(x, 4).alias(x) for x in ROUND4])


@query("m12_sliced_metrics", with_fact(f"SELECT agent, {METRIC} FROM (SELECT *, {_avg_rank('y', 'PARTITION BY agent')} AS ry, {_avg_rank('p', 'PARTITION BY agent')} AS rp FROM v) GROUP BY 1", SCORED))
def m12(spark, d):
    return metrics.sliced_metrics(_scored(spark, d), "agent").select("agent", "n", *[F.round(x, 4).alias(x) for x in ROUND4])


@query("m10_baselines", with_fact("SELECT player_id, match_id, map, coalesce(h, c.m) AS baseline_history, c.m AS train_mean FROM (SELECT player_id, match_id, map, avg(rating) OVER (PARTITION BY player_id ORDER BY ts, match_id, map ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM fact), (SELECT avg(rating) AS m FROM fact WHERE ts < TIMESTAMP '1999-01-01') c"))
def m10(spark, d):
    f = fact(spark, d)
    w = Window.partitionBy("player_id").orderBy("ts", "match_id", "map").rowsBetween(-5, -1)
    h = f.select(*KEY, F.avg("rating").over(w).alias("h"))
    return metrics.baseline_predictions(h, f.where(F.col("ts") < F.lit(CUT).cast("timestamp")), "rating", "h", "h").select(*KEY, "baseline_history", "train_mean")


@query(
    "m15_calibration",
    with_fact("SELECT round(CASE WHEN c / w > 3 THEN 3 WHEN c / w < 0.25 THEN 0.25 ELSE c / w END, 4) AS slope, round(my - CASE WHEN c / w > 3 THEN 3 WHEN c / w < 0.25 THEN 0.25 ELSE c / w END * mp, 4) AS intercept FROM (SELECT covar_pop(y, p) AS c, var_pop(p) AS w, avg(y) AS my, avg(p) AS mp FROM v2)", SCORED, "v2 AS (SELECT y, y * 0.5 + 10 + p * 0.1 AS p FROM v)"),
)
def m15(spark, d):
    s = _scored(spark, d).where("actual is not null and prediction is not null").withColumn("prediction", F.col("actual") * 0.5 + 10 + F.col("prediction") * 0.1)
    k = metrics.fit_calibration(s)
    return s.select(F.round(F.lit(k["slope"]), 4).alias("slope"), F.round(F.lit(k["intercept"]), 4).alias("intercept")).distinct()
