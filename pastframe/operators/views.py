"""History views: rosters, catalogs, match-grain trends, forecast requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAPS = ["match_id", "map"]


def of_team(df: DataFrame, team_id: int, region: str | None = None) -> DataFrame:
    out = df.where(F.col("team_id") == team_id)
    return out.where(F.col("region") == region) if region is not None else out


def map_keys(df: DataFrame) -> DataFrame:
    """Distinct (match, map) in time order."""
    return df.groupBy(*MAPS).agg(F.min("ts").alias("ts")).orderBy("ts", *MAPS)


def latest_maps(df: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The rows of each group's last n maps: an aggregation to map grain, a window, a semi-join."""
    keys = df.groupBy(*by, *MAPS).agg(F.min("ts").alias("ts"))
    w = Window.partitionBy(*by).orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in MAPS])
    last = keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return df.join(last.select(*by, *MAPS), [*by, *MAPS], "left_semi")


def recent_roster(df: DataFrame, by: list[str] = ("team_id",), n: int = 5) -> DataFrame:
    """Players of each team's last n maps: last date, matches in the window, latest agent and all agents, newest first."""
    recent = latest_maps(df, list(by), n)
    entry = F.struct((-F.unix_micros("ts")).alias("t"), (-F.col("match_id")).alias("m"), F.col("map").alias("p"), "agent", "role")
    seen = F.array_sort(F.collect_list(entry))
    g = recent.groupBy(*by, "player_id").agg(seen.alias("e"), F.max("ts").alias("last_map_ts"), F.count_distinct("match_id").alias("maps_in_window"))
    agents = F.array_distinct(F.array_compact(F.transform("e", lambda x: x["agent"])))
    return g.select(*by, "player_id", "last_map_ts", "maps_in_window", F.col("e")[0]["agent"].alias("agent"), F.col("e")[0]["role"].alias("role"), F.array_join(agents, " / ").alias("recent_agents"))


def first_known(c: str, order: list[str]) -> Column:
    """The first non-null value in the order."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))


def map_history(df: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """One row per (match, map): the earliest time and the first known value of each field; newest first."""
    g = df.groupBy(*MAPS).agg(F.min("ts").alias("ts"), *[first_known(c, order).alias(c) for c in fields])
    return g.orderBy(F.col("ts").desc(), F.col("match_id").desc(), F.col("map").desc())


def match_trend(df: DataFrame, by: list[str], metrics: list[str], limit: int = 10) -> DataFrame:
    """Match-grain means of the last ``limit`` matches of each group, with the maps played, oldest first by ``place``."""
    if limit < 1:
        raise ValueError("limit must be positive")
    g = df.groupBy(*by, "match_id").agg(F.min("ts").alias("ts"), *[F.avg(m).alias(m) for m in metrics], F.array_join(F.array_sort(F.collect_set("map")), ", ").alias("maps"))
    w = Window.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("match_id").desc())
    last = g.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ts", "match_id"))).drop("_n")


def player_history(df: DataFrame, player_id: int, team_id: int | None = None) -> DataFrame:
    out = df.where(F.col("player_id") == player_id)
    out = out.where(F.col("team_id") == team_id) if team_id is not None else out
    return out.orderBy(F.col("ts").desc(), F.col("match_id").desc(), F.col("map").desc())


def team_results(df: DataFrame, by: str = "team_id", n: int = 10) -> DataFrame:
    """Each team's last n maps with whether it won."""
    g = df.groupBy(by, *MAPS).agg(F.min("ts").alias("ts"), F.min("team").alias("team"), F.min("map_winner").alias("map_winner"))
    w = Window.partitionBy(by).orderBy(F.col("ts").desc(), F.col("match_id").desc(), F.col("map").desc())
    won = F.lower(F.trim("map_winner")) == F.lower(F.trim("team"))
    return g.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).withColumn("won", won)


def team_catalog(df: DataFrame, by: list[str] = ("team_id",), order: list[str] = ("ts", "match_id", "map")) -> DataFrame:
    """One row per team: the first name seen, as label too."""
    g = df.where("team_id is not null").groupBy(*by).agg(F.min_by("team", F.struct(*order)).alias("team"))
    return g.withColumn("display_name", F.concat("team", F.lit(" · id="), F.col("team_id").cast("string")))


def opponents(df: DataFrame) -> DataFrame:
    """Teams that each team has met."""
    g = df.where("opponent_team_id is not null").groupBy("team_id", "opponent_team_id").agg(first_known("opponent_team", ["ts", "match_id", "map"]).alias("opponent_team"), F.count_distinct(*MAPS).alias("maps"))
    return g


def other_teams(catalog: DataFrame, team_id: int) -> DataFrame:
    return catalog.where(F.col("team_id") != team_id).dropDuplicates(["team_id"])


def recent_means(df: DataFrame, by: str, metrics: list[str], n: int = 10) -> DataFrame:
    """Means over each entity's last n rows."""
    w = Window.partitionBy(by).orderBy(F.col("ts").desc(), F.col("match_id").desc(), F.col("map").desc())
    last = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return last.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("maps"))


METRICS = ["rating", "acs", "kda", "kills", "deaths", "assists", "adr", "kast"]


def chart_rows(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long form of one or two known metrics."""
    if not 1 <= len(metrics) <= 2 or len(set(metrics)) != len(metrics):
        raise ValueError("choose one or two different metrics")
    if bad := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"unknown metrics: {bad}")
    return df.unpivot(ids, metrics, "metric", "value")


def chart_pivot(long: DataFrame, x: str, metrics: list[str]) -> DataFrame:
    return long.groupBy(x).pivot("metric", metrics).agg(F.avg("value"))


def hashed_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hashes of their key: the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def forecast_requests(history: DataFrame, team_id: int, opponent_team_id: int, players: list[int], at: str, maps: list[str], agents: dict[int, str] | None = None) -> DataFrame:
    """One row per player and map to forecast: the player's latest row gives the rest. A player without history is an error."""
    if opponent_team_id is None:
        raise ValueError("opponent_team_id is required for a forecast")
    spark = history.sparkSession
    rows = of_team(history, team_id).where(F.col("player_id").isin(players))
    last = rows.groupBy("player_id").agg(F.max_by(F.struct("team_id", "team", "agent", "role"), F.struct("ts", *MAPS)).alias("l"))
    if lost := sorted(set(players) - {r.player_id for r in last.select("player_id").collect()}):
        raise ValueError(f"no completed history for players {lost}")
    grid = spark.createDataFrame([(m,) for m in maps], "map string")  # as long as the caller's list
    chosen = [F.when(F.col("player_id") == p, F.lit(a)) for p, a in (agents or {}).items()]
    agent = F.coalesce(*chosen, F.lit("__unknown__"))
    return last.join(F.broadcast(grid)).select(
        "player_id",
        F.concat(F.lit("__inference_"), F.col("player_id").cast("string"), F.lit("_"), F.col("map")).alias("match_id"),
        "map",
        F.lit(at).cast("timestamp").alias("ts"),
        F.col("l.team_id").alias("team_id"),
        F.lit(opponent_team_id).cast("long").alias("opponent_team_id"),
        F.col("l.team").alias("team"),
        agent.alias("agent"),
        F.col("l.role").alias("role"),
    )


def next_requests(history: DataFrame, at: str) -> DataFrame:
    """For each player one request at that time: team, opponent, map and agent of the player's latest row."""
    same = ["map", "team_id", "opponent_team_id", "team", "opponent_team", "agent", "role"]
    last = history.where("player_id is not null").groupBy("player_id").agg(F.max_by(F.struct(*same), F.struct("ts", *MAPS)).alias("l"))
    name = F.concat(F.lit("__inference_"), F.col("player_id").cast("string"))
    return last.select("player_id", name.alias("match_id"), F.lit(at).cast("timestamp").alias("ts"), *[F.col(f"l.{c}").alias(c) for c in same])


def relevant_history(history: DataFrame, requests: DataFrame) -> DataFrame:
    """History of the requested players or of either team."""
    p = requests.select("player_id").distinct().withColumn("_p", F.lit(True))
    t = requests.select(F.explode(F.array("team_id", "opponent_team_id")).alias("team_id")).where("team_id is not null").distinct().withColumn("_t", F.lit(True))
    return history.join(p, "player_id", "left").join(t, "team_id", "left").where("_p or _t").select(history.columns)


def lineup_summary(forecasts: DataFrame, by: str, targets: list[str]) -> DataFrame:
    return forecasts.groupBy(by).agg(*[F.avg(t).alias(t) for t in targets])


def shortlist(scores: DataFrame, keep: int = 2) -> DataFrame:
    """Per target, of the candidates with the lowest errors the one with the least (mae, mae_std)."""
    w = Window.partitionBy("target").orderBy("mae", "model")
    return scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).withColumn("chosen", F.row_number().over(Window.partitionBy("target").orderBy("mae", "mae_std", "model")) == 1).drop("_n")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fill_tags(df: DataFrame, by: list[str], order: str, tag: str, ids: list[str]) -> DataFrame:
    """Team ids for rows whose tags are partly blank: tags carry forward, the first tag seen takes the first id, the second
    the other; rows of no known tag take the first id in the first half of the group, the second after it, or the only tag's id."""
    w = Window.partitionBy(*by).orderBy(order)
    t = F.nullif(F.trim(F.col(tag)), F.lit(""))
    out = df.withColumn("_t", F.last(t, ignorenulls=True).over(w))
    first = out.where("_t is not null").groupBy(*by, "_t").agg(F.min(order).alias("_f"))
    rank = first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_f"))).drop("_f")
    tags = rank.groupBy(*by).agg(F.count(F.lit(1)).alias("_tags"))
    half = F.row_number().over(w) <= F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*by)) / 2)
    one, two = (F.col(c) for c in ids)
    out = out.withColumn("_half", half).join(rank, [*by, "_t"], "left").join(tags, by, "left")
    free = F.when(F.col("_tags") == 1, one).when(F.col("_half"), one).otherwise(two)
    return out.withColumn("assigned_id", F.when(F.col("_r") == 1, one).when(F.col("_r") == 2, two).otherwise(free)).drop("_t", "_r", "_tags", "_half")
