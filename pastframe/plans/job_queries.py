"""Queries of whole jobs: the dataset from raw tables, error slices, baselines, saved models."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, dataset, elo, features, graph, metrics, ml, pit, profile, splits, views
from .fact import ORDER, barrier_sql, fact, table, with_fact
from .history_queries import TEAMS, TH
from .ml_queries import CATEGORIES, NUMERIC
from .table_queries import NUMS, ROUND4

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


# --- the dataset from raw tables ------------------------------------------------

AGENTS = ["jett", "omen", "sage", "sova", "nobody"]
LAST = ", ".join(f"{c} DESC" for c in ORDER)


def _raw(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as raw players and maps, both with repeats of a key, orders as matches; all as text."""
    lines = table(spark, d, "lineitem").selectExpr(
        "*",
        "concat('map', l_linenumber % 3) AS map",
        "l_orderkey % 25 AS one",
        "(l_orderkey % 25 + 1 + l_orderkey % 24) % 25 AS two",
        "element_at(array(" + ", ".join(f"'{a}'" for a in AGENTS) + "), cast(l_partkey % 5 + 1 AS int)) AS agent",
    )
    whole = lambda c: f"cast(cast(round({c}) AS bigint) AS string)"
    players = lines.selectExpr(
        "concat('p', l_suppkey) AS name", "cast(l_suppkey AS string) AS player_id", "cast(l_orderkey AS string) AS match_id", "map", "agent",
        # The last rows of some keys have no team: they go before the last one is kept.
        "CASE WHEN l_partkey % 5 <> 3 THEN cast(CASE WHEN l_linenumber % 2 = 0 THEN one ELSE two END AS string) END AS team_id",
        "CASE WHEN l_quantity <> 50 THEN cast(l_quantity AS string) ELSE 'n/a' END AS rating2_all",
        f"{whole('l_extendedprice')} AS acs_all", f"{whole('l_quantity')} AS kills_all", f"{whole('l_tax * 100')} AS deaths_all",
        f"{whole('l_discount * 100')} AS assists_all", f"concat({whole('l_quantity')}, '%') AS kast_all", *ORDER,
    )
    maps = lines.selectExpr(
        "l_orderkey AS match_id", "map AS map_name", "concat('team', one) AS team_1", "concat('team', two) AS team_2", "one AS team_1_id", "two AS team_2_id",
        "CASE WHEN l_quantity > 26 THEN concat('team', one) WHEN l_quantity < 24 THEN concat('team', two) WHEN l_quantity = 25 THEN ' Draw' END AS map_winner", "l_suppkey", *ORDER,
    )
    matches = table(spark, d, "orders").selectExpr("o_orderkey AS match_id", "o_custkey AS event_id", "date_format(o_orderdate, 'yyyy-MM-dd') AS match_date", "element_at(array('Group Stage', 'Playoffs', 'Grand Final', 'Showmatch'), cast(o_custkey % 4 + 1 AS int)) AS stage")
    return players, matches, maps


ORDERS = {"players": ORDER, "matches": ["event_id"], "maps": [*ORDER, "l_suppkey"]}
RAW_SQL = f"""WITH x AS (SELECT *, 'map' || (l_linenumber % 3) AS map, l_orderkey % 25 AS one, (l_orderkey % 25 + 1 + l_orderkey % 24) % 25 AS two FROM lineitem),
p AS (SELECT * FROM x WHERE l_partkey % 5 <> 3 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, map ORDER BY {LAST}) = 1),
t AS (SELECT l_orderkey, map, CASE WHEN l_quantity > 26 THEN 'team' || one WHEN l_quantity < 24 THEN 'team' || two WHEN l_quantity = 25 THEN ' Draw' END AS map_winner
  FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey, map ORDER BY {LAST}, l_suppkey DESC) = 1)
SELECT l_suppkey AS player_id, l_orderkey AS match_id, map, CASE WHEN l_linenumber % 2 = 0 THEN one ELSE two END::BIGINT AS team_id,
  CASE WHEN CASE WHEN l_linenumber % 2 = 0 THEN one ELSE two END = one THEN two ELSE one END::BIGINT AS opponent_team_id,
  'team' || CASE WHEN CASE WHEN l_linenumber % 2 = 0 THEN one ELSE two END = one THEN two ELSE one END AS opponent_team, t.map_winner,
  (['Duelist', 'Controller', 'Sentinel', 'Initiator', 'Flex/Unknown'])[(l_partkey % 5 + 1)::INT] AS role, o_custkey AS event_id,
  CASE WHEN o_custkey IS NULL THEN NULL ELSE ([0.4, 0.8, 1.0, 0.5])[(o_custkey % 4 + 1)::INT] END::DOUBLE AS match_importance, l_quantity AS rating2_all, round(l_quantity / 100.0, 4)::DOUBLE AS kast_all,
  round((l_quantity + round(l_discount * 100)) / nullif(round(l_tax * 100), 0), 4) AS kda_all, date_trunc('day', o_orderdate)::TIMESTAMP AS ts
FROM p JOIN t USING (l_orderkey, map) LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity <> 50"""


@query("f10_dataset_j1_j2", RAW_SQL)
def f10(spark, d):
    return f10_columns(dataset.build_dataset(*_raw(spark, d), ORDERS, elo=False))


def f10_columns(out: DataFrame) -> DataFrame:
    return out.select(*KEY, "team_id", "opponent_team_id", "opponent_team", "map_winner", "role", "event_id", "match_importance", "rating2_all", F.round("kast_all", 4).alias("kast_all"), F.round("kda_all", 4).alias("kda_all"), "ts")


@query("io5_bucketed_dataset", RAW_SQL)
def io5(spark, d):
    """The same from raw tables that are staged in buckets of one match, in a session that lets them serve joins on more columns."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    run = uuid.uuid4().hex
    staged = [dataset.stage_by_match(df, f"raw_{name}_{run}", f"{graph.shared_folder(spark)}/raw-{run}/{name}", 16) for df, name in zip(_raw(own, d), ORDERS, strict=True)]
    return f10_columns(dataset.build_dataset(*staged, ORDERS, elo=False))


@query("j7_dataset_with_elo")
def j7(spark, d):
    return dataset.build_dataset(*_raw(spark, d), ORDERS).select(*KEY, *[F.round(c, 4).alias(c) for c in ("team_elo", "opponent_elo", "elo_gap")])


@query(
    "a5_gate_findings",
    """WITH m AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS id, CASE WHEN o_custkey % 100 <> 7 THEN o_orderpriority END AS region, o_custkey % 40 = 3 AS bad FROM orders),
l AS (SELECT *, 'map' || (l_linenumber % 3) AS map FROM lineitem),
f AS (SELECT 'matches' AS "table", 'missing_region' AS finding, 'error' AS level, count(*) - count(region) AS n FROM m
UNION ALL SELECT 'matches', 'duplicate_keys', 'error', count(*) - count(DISTINCT coalesce(id, -1)) FROM m
UNION ALL SELECT 'matches', 'unreadable_dates', 'warning', count(*) FILTER (bad) FROM m
UNION ALL SELECT 'players_stat', 'duplicate_keys', 'error', count(*) - count(DISTINCT (l_suppkey, l_orderkey, map)) FROM l
UNION ALL SELECT 'players_stat', 'missing_acs_all', 'warning', CASE WHEN avg((l_discount = 0)::INT) > 0.05 THEN count(*) FILTER (l_discount = 0) ELSE 0 END FROM l
UNION ALL SELECT 'players_stat', 'missing_rating2_all', 'warning', CASE WHEN avg((l_quantity = 50)::INT) > 0.05 THEN count(*) FILTER (l_quantity = 50) ELSE 0 END FROM l
UNION ALL SELECT 'players_stat', 'orphan_rows', 'error', count(*) FROM l WHERE l_orderkey NOT IN (SELECT id FROM m WHERE id IS NOT NULL)
UNION ALL SELECT 'match_maps_stat', 'missing_columns', 'error', 1
UNION ALL SELECT 'match_maps_stat', 'duplicate_keys', 'error', count(*) - count(DISTINCT (l_orderkey, map)) FROM l
UNION ALL SELECT 'match_maps_stat', 'orphan_rows', 'error', count(*) FROM l WHERE l_orderkey NOT IN (SELECT id FROM m WHERE id IS NOT NULL))
SELECT * FROM f WHERE n > 0""",
)
def a5(spark, d):
    lines = table(spark, d, "lineitem").withColumn("map", F.expr("concat('map', l_linenumber % 3)"))
    matches = table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS match_id", "CASE WHEN o_custkey % 100 <> 7 THEN o_orderpriority END AS region", "o_orderstatus AS match_url",
        "o_custkey AS event_id", "CASE WHEN o_custkey % 40 = 3 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS match_date",
    )
    players = lines.selectExpr(
        "l_returnflag AS region", "l_suppkey AS player_id", "l_partkey AS team_id", "l_linestatus AS agent", "map", "l_orderkey AS match_id",
        "nullif(l_quantity, 50.0D) AS rating2_all", "CASE WHEN l_discount <> 0 THEN l_extendedprice END AS acs_all", "l_quantity AS kills_all", "l_tax AS deaths_all",
    )
    maps = lines.selectExpr("l_returnflag AS region", "l_orderkey AS match_id", "map AS map_name", "l_suppkey AS team_1_id", "l_partkey AS team_2_id", "l_linestatus AS map_winner")
    return audit.gate_findings({"matches": matches, "players_stat": players, "match_maps_stat": maps})


# --- profile, slices, manifest ------------------------------------------------------


@query("a18_deletion_cost", with_fact(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) FILTER ({x} IS NULL) AS missing, count(*) FILTER ({x} IS NULL) * 100.0::DOUBLE / count(*) AS percent, count(*) FILTER ({x} IS NULL) AS rows_deleted, count({x}) AS rows_retained FROM fact" for x in NUMS)))
def a18(spark, d):
    return profile.deletion_cost(fact(spark, d).select(NUMS))


_bucket = lambda c: f"CASE WHEN {c} <= 0 THEN 'cold_start' WHEN {c} <= 5 THEN '1-5' WHEN {c} <= 20 THEN '6-20' ELSE '21+' END"
_rank = lambda x: f"rank() OVER (PARTITION BY slice, value ORDER BY {x}) + (count(*) OVER (PARTITION BY slice, value, {x}) - 1) / 2.0"
SLICED = {
    "map": "map", "agent": "agent", "role": "role", "experience_bucket": _bucket("n"), "role_experience": _bucket("rn"), "time_period": "period::VARCHAR",
    "known_opponent": "CASE WHEN opponent IS NOT NULL THEN 'known' ELSE 'unknown' END", "known_map": "CASE WHEN mn > 0 THEN 'known' ELSE 'unknown' END",
    "roster_stability": "CASE WHEN same >= 0.8 THEN 'stable' ELSE 'changed_or_unknown' END",
}


@query(
    "m12_nine_slices_p22",
    with_fact(
        "SELECT slice, value, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, CASE WHEN var_pop(y) > 0 THEN round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) END AS r2, "
        f"round(CASE WHEN isnan(corr(ry, rp)) THEN NULL ELSE corr(ry, rp) END, 4) AS spearman FROM (SELECT *, {_rank('y')} AS ry, {_rank('p')} AS rp FROM u WHERE y IS NOT NULL AND p IS NOT NULL) GROUP BY 1, 2",
        TEAMS, TH,
        "a AS (" + barrier_sql("player_id", {"n": ("count(*)", None), "p": ("avg(rating)", 5)}) + ")",
        "b AS (" + barrier_sql("player_id, map", {"mn": ("count(*)", 100)}) + ")",
        "c AS (" + barrier_sql("player_id, role", {"rn": ("count(*)", 100)}) + ")",
        "w AS (SELECT f.*, f.rating AS y, a.n, a.p, b.mn, c.rn, o.team_rating_last_5 AS opponent, CASE WHEN s.before IS NOT NULL THEN len(list_intersect(s.roster, s.before)) / len(s.roster) END AS same,"
        " greatest(0, ceil((row_number() OVER (ORDER BY f.ts, match_id, map, player_id) - 1) * 4.0 / (count(*) OVER () - 1)) - 1)::INT AS period"
        " FROM fact f JOIN a USING (player_id, match_id, map) JOIN b USING (player_id, match_id, map) JOIN c USING (player_id, match_id, map)"
        " LEFT JOIN th s ON s.match_id = f.match_id AND s.map = f.map AND s.team_id = f.team_id LEFT JOIN th o ON o.match_id = f.match_id AND o.map = f.map AND o.team_id = f.opponent_team_id)",
        "u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS slice, coalesce({v}, '__unknown__') AS value, y, p FROM w" for k, v in SLICED.items()) + ")",
    ),
)
def m12(spark, d):
    f = splits.checkpointed(fact(spark, d))  # read for the teams and for the rows
    out = features.add_team_features(f, features.team_history(features.team_maps(f)))
    out = pit.barrier(out, ["player_id"], {"player_matches_played": (F.count(F.lit(1)), None), "prediction": (F.avg("rating"), 5)})
    for key in ("map", "role"):
        out = pit.barrier(out, ["player_id", key], {f"player_{key}_matches_played": (F.count(F.lit(1)), 100)})
    used = ["ts", *KEY, "agent", "role", "rating", "prediction", "player_matches_played", "player_role_matches_played", "player_map_matches_played", "opponent_rating_last_5", "lineup_continuity"]
    report = metrics.slice_report(metrics.slice_columns(out.select(used)), y="rating")
    return report.select("slice", "value", "n", *[F.round(x, 4).alias(x) for x in ROUND4])


# --- baselines and saved models -------------------------------------------------------


@query("m10_elo_and_team_lines")
def m10(spark, d):
    f = splits.checkpointed(fact(spark, d))  # read for the ratings, the teams, the matches' order and the rows
    one = F.concat(F.lit("team"), F.col("team_1_id").cast("string"))
    named = f.withColumns({"team_1": one, "team_2": F.concat(F.lit("team"), F.col("team_2_id").cast("string"))})
    rows = splits.chronological_split(f.select(*KEY, "ts", "team_id", "opponent_team_id", "team_1_id", "rating"))
    rows = elo.add_elo(rows, elo.rate_maps(dataset.map_results(named)))
    rows = splits.checkpointed(features.add_team_features(rows, features.team_history(features.team_maps(f))))
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    out = ml.baseline_lines(train, test.where("rating is not null"), "rating")
    return views.union_all([metrics.metrics(out, "rating", c).select(F.lit(c).alias("baseline"), "*") for c in ("elo_only", "team_opponent_historical")])


@query("m22_saved_models_again")
def m22(spark, d):
    from .ml_queries import _features

    rows = _features(spark, d).drop("match_idx", "split")
    train = splits.checkpointed(splits.chronological_split(rows).where("split = 'train'"))  # read by every fit
    folder, paths = f"{graph.shared_folder(spark)}/models-{uuid.uuid4().hex}", {}
    for target in ("rating", "acs", "kda"):
        paths[f"ridge_{target}"] = f"{folder}/{target}"
        ml.fit(train, "ridge", target, NUMERIC, CATEGORIES).save(paths[f"ridge_{target}"])
    return ml.reevaluate(rows, paths)
