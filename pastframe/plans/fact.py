"""The fact table that the queries run on, made from the star-schema tables.

A line item stands for one player's map: the supplier is the player, the order
the match, the line number gives the map and the side. The customer's nation and
another one are the two teams. Rows repeat on the key, days hold many matches,
and some metrics are null, so that those paths run. Metrics are whole numbers,
so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import add_roles, ratio
from ..operators.dedup import keep_last
from ..operators.joins import many_to_one

# Part types as agents with roles.
TYPE_ROLES = {"standard": ("Duelist", 0.98), "small": ("Initiator", 0.98), "medium": ("Controller", 0.95), "large": ("Sentinel", 0.98), "economy": ("Duelist", 0.95)}
ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, match_id, map, ts, side, team_1_id, team_2_id, team_id, opponent_team_id, team, opponent_team, map_winner, agent, role,
    role_confidence, rating, acs, kda, stage; one row per (player_id, match_id, map)."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").withColumn("map", F.concat(F.lit("map"), (F.col("l_linenumber") % 3).cast("string")))
    orders = table(spark, sf_dir, "orders").where("o_orderdate is not null").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.collect_list(F.struct(F.col("p_type").alias("agent"))).alias("agents"))
    # Lines move twice, to their part and to their order: the keys of what follows contain the order. A part's rows are kept in a list until the last one of a key is chosen.
    lines = many_to_one(lines, parts, ["l_partkey"], check=False).repartition("l_orderkey")
    df = keep_last(lines, ["l_suppkey", "l_orderkey", "map"], ORDER)
    df = df.join(many_to_one(orders, customers, ["o_custkey"], check=False), "l_orderkey")
    side, times = F.col("l_linenumber") % 2, F.when(F.col("agents").isNull(), 1).otherwise(F.size("agents"))
    df = df.withColumns(
        {
            "team_1_id": F.col("c_nationkey").cast("long"),
            "team_2_id": ((F.col("c_nationkey") + 1 + F.col("l_orderkey") % 24) % 25).cast("long"),
            "side": side,
        }
    )
    own = lambda a, b: F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b))
    df = df.withColumns({"team_id": own("team_1_id", "team_2_id"), "opponent_team_id": own("team_2_id", "team_1_id")})
    sides = Window.partitionBy("l_orderkey", "map")
    score = lambda i: F.when(F.col("map").isNotNull(), F.sum(F.when(F.col("side") == i, times * F.col("l_quantity")).otherwise(0.0)).over(sides))
    df = df.withColumns({"a": score(0), "b": score(1)}).select("*", F.explode_outer("agents").alias("_part")).withColumn("agent", F.col("_part.agent"))
    name = lambda c: F.concat(F.lit("team"), F.col(c).cast("string"))
    df = df.select(
        F.col("l_suppkey").alias("player_id"),
        F.col("l_orderkey").alias("match_id"),
        "map",
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        "side",
        "team_1_id",
        "team_2_id",
        "team_id",
        "opponent_team_id",
        name("team_id").alias("team"),
        name("opponent_team_id").alias("opponent_team"),
        F.when(F.col("a") > F.col("b"), name("team_1_id")).when(F.col("b") > F.col("a"), name("team_2_id")).otherwise("Draw").alias("map_winner"),
        "agent",
        F.nullif("l_quantity", F.lit(50.0)).alias("rating"),
        F.when(F.col("l_discount") != 0, F.round("l_extendedprice")).alias("acs"),
        F.round(100 * ratio(F.col("l_quantity") + F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100))).alias("kda"),
        F.col("o_orderpriority").alias("stage"),
    )
    return add_roles(df, table=TYPE_ROLES)


FACT_SQL = """
l0 AS (SELECT *, 'map' || (l_linenumber % 3) AS map FROM lineitem),
l1 AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, map ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC,
  l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1),
l2 AS (SELECT l1.*, o_orderdate, o_orderpriority, p_type AS agent, c_nationkey::BIGINT AS team_1_id, ((c_nationkey + 1 + l_orderkey % 24) % 25)::BIGINT AS team_2_id, l_linenumber % 2 AS side
  FROM l1 JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey),
l3 AS (SELECT *, CASE WHEN side = 0 THEN team_1_id ELSE team_2_id END AS team_id, CASE WHEN side = 0 THEN team_2_id ELSE team_1_id END AS opponent_team_id,
  sum(CASE WHEN side = 0 THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_orderkey, map) AS sa, sum(CASE WHEN side = 1 THEN l_quantity ELSE 0 END) OVER (PARTITION BY l_orderkey, map) AS sb FROM l2),
fact AS (SELECT l_suppkey AS player_id, l_orderkey AS match_id, map, o_orderdate AS ts, side, team_1_id, team_2_id, team_id, opponent_team_id,
  'team' || team_id AS team, 'team' || opponent_team_id AS opponent_team,
  CASE WHEN sa > sb THEN 'team' || team_1_id WHEN sb > sa THEN 'team' || team_2_id ELSE 'Draw' END AS map_winner, agent,
  nullif(l_quantity, 50.0) AS rating, CASE WHEN l_discount <> 0 THEN round(l_extendedprice) END AS acs,
  round(100 * ((l_quantity + round(l_discount * 100)) / nullif(round(l_tax * 100), 0))) AS kda, o_orderpriority AS stage,
  CASE agent WHEN 'STANDARD' THEN 'Duelist' WHEN 'SMALL' THEN 'Initiator' WHEN 'MEDIUM' THEN 'Controller' WHEN 'LARGE' THEN 'Sentinel' WHEN 'ECONOMY' THEN 'Duelist' ELSE 'Flex/Unknown' END AS role,
  CASE agent WHEN 'STANDARD' THEN 0.98::DOUBLE WHEN 'SMALL' THEN 0.98 WHEN 'MEDIUM' THEN 0.95 WHEN 'LARGE' THEN 0.98 WHEN 'ECONOMY' THEN 0.95 ELSE 0.0 END AS role_confidence
  FROM l3)
"""


def with_fact(select: str, *more: str) -> str:
    """SQL over the fact table, after further common table expressions."""
    return "WITH " + ",\n".join([FACT_SQL.strip(), *more]) + "\n" + select


def barrier_sql(keys: str, features: dict[str, tuple[str, int | None]], source: str = "fact", keep: str = "player_id, match_id, map", order: str = "match_id, map") -> str:
    """Plain SQL of the barrier windows: rows frames, then the first value of each (key, timestamp)."""
    raw = ", ".join(
        f"{agg} OVER (PARTITION BY {keys} ORDER BY ts, {order} ROWS BETWEEN {'UNBOUNDED' if n is None else n} PRECEDING AND 1 PRECEDING) AS r_{name}" for name, (agg, n) in features.items()
    )
    out = ", ".join(f"first_value(r_{name}) OVER (PARTITION BY {keys}, ts ORDER BY {order}) AS {name}" for name in features)
    return f"SELECT {keep}, {out} FROM (SELECT *, {raw} FROM {source})"


def entry_sql(keys: str, features: dict[str, tuple[str, int]], source: str, keep: str, order: str = "match_id, map") -> str:
    """The same where only rows marked entry are history: ranges over the running number of entries."""
    placed = f"SELECT *, 2 * sum(entry::INT) OVER (PARTITION BY {keys} ORDER BY ts, {order} ROWS UNBOUNDED PRECEDING) + CASE WHEN entry THEN 0 ELSE 1 END AS place FROM {source}"
    raw = ", ".join(f"{agg} OVER (PARTITION BY {keys} ORDER BY place RANGE BETWEEN {2 * n} PRECEDING AND 1 PRECEDING) AS r_{name}" for name, (agg, n) in features.items())
    out = ", ".join(f"first_value(r_{name}) OVER (PARTITION BY {keys}, ts ORDER BY {order}) AS {name}" for name in features)
    return f"SELECT {keep}, {out} FROM (SELECT *, {raw} FROM ({placed}))"
