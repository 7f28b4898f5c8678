"""The end-to-end job: raw players, matches and maps to one cleaned table at player and map grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import add_roles, match_timestamp, percent, ratio, stage_importance, to_number
from ..sources.tables import write_bucketed
from .dedup import keep_last
from .elo import add_elo, rate_maps
from .joins import many_to_one, other_side

# Names of the raw columns.
NUMBERS = [f"{m}_{s}" for m in ("rating2", "acs", "kills", "deaths", "assists", "adr", "fb", "fd") for s in ("all", "t", "ct")]
SHARES = [f"{m}_{s}" for m in ("kast", "hsp") for s in ("all", "t", "ct")]
IDS = ["player_id", "match_id", "team_id", "team_1_id", "team_2_id"]
REQUIRED = ["rating2_all", "acs_all", "kills_all", "deaths_all"]
KEPT = [
    "player_name", "region", "player_id", "team", "team_id", "opponent_team", "opponent_team_id", "team_elo", "opponent_elo", "elo_gap",
    "agent", "map", "match_id", "event_id", "event_stage", "event_round", "patch", "match_importance", "match_date", "match_time", "ts",
    "team_1", "team_2", "team_pick", "role", "role_confidence", "map_winner", "first_half_ct_win_rounds", "first_half_t_win_rounds",
    "second_half_ct_win_rounds", "second_half_t_win_rounds", "ot_team_ct_win", "ot_team_t_win",
]


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where the new name isn't taken; an old one beside it goes."""
    for old, new in names.items():
        if old in df.columns:
            df = df.drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df


def _whole(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as longs; those that are stay as they are, and so does a layout by them."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: to_number(c).cast("long") for c in columns if kinds.get(c, "bigint") != "bigint"})


def stage_by_match(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """A raw table with whole ids, without rows that name no match, bucketed by match_id.

    ``build_dataset`` over three such tables of equally many buckets dedups and joins them
    without a shuffle (see ``write_bucketed``), however often it runs.
    """
    return write_bucketed(_whole(df, IDS).dropna(subset=["match_id"]), name, ["match_id"], buckets, path)


def clean_players(players: DataFrame, order: list[str]) -> DataFrame:
    """Numbers and shares from text, kda, roles, one row per (player_id, match_id, map): the last in ``order`` of those with a match and a team."""
    df = _renamed(_whole(players, ["player_id", "match_id", "team_id"]), {"name": "player_name"}).dropna(subset=["match_id", "team_id"])
    df = keep_last(df, ["player_id", "match_id", "map"], order, ["match_id"])
    df = df.withColumns({c: to_number(c) for c in NUMBERS if c in df.columns} | {c: percent(c) for c in SHARES if c in df.columns})
    return add_roles(df.withColumn("kda_all", ratio(F.col("kills_all") + F.col("assists_all"), F.col("deaths_all"))))


def clean_matches(matches: DataFrame, order: list[str]) -> DataFrame:
    """One row per match_id with its importance: the supplied one, else by stage and round."""
    df = _renamed(_whole(matches, ["match_id"]), {"stage": "event_stage", "round": "event_round", "patch_version": "patch"})
    text = lambda c: c if c in df.columns else F.lit(None).cast("string")
    derived = stage_importance(text("event_stage"), text("event_round"))
    given = to_number("match_importance") if "match_importance" in df.columns else F.lit(None).cast("double")
    return keep_last(df.where("match_id is not null"), ["match_id"], order).withColumn("match_importance", F.coalesce(given, derived))


def clean_maps(maps: DataFrame, order: list[str]) -> DataFrame:
    """One row per (match_id, map)."""
    df = _renamed(_whole(maps, ["match_id", "team_1_id", "team_2_id"]), {"map_name": "map", "patch_version": "patch"})
    return keep_last(df, ["match_id", "map"], order, ["match_id"])


def map_results(df: DataFrame) -> DataFrame:
    """One row per (match_id, map) with the result for team 1; an unknown winner has none."""
    won = F.when(F.col("map_winner") == F.col("team_1"), 1.0).when(F.col("map_winner") == F.col("team_2"), 0.0).when(F.lower(F.trim("map_winner")) == "draw", 0.5)
    return df.groupBy("match_id", "map").agg(*[F.min(c).alias(c) for c in ("ts", "team_1_id", "team_2_id")], F.max(won).alias("result"))


def build_dataset(players: DataFrame, matches: DataFrame, maps: DataFrame, orders: dict[str, list[str]], elo: bool = True, pool: str | None = None) -> DataFrame:
    """The dataset of all player rows that have a match, a team, a map and the required metrics.

    ``orders``: for players, matches and maps the columns that say which of several rows of
    a key is the last. Joins are many to one by construction. A map's own team ids give the
    opponent; where the maps table lacks a map, opponent and Elo are null. With ``elo``,
    both teams' ratings before the map are joined on.
    """
    m = clean_matches(matches, orders["matches"])
    t = clean_maps(maps, orders["maps"])
    p = clean_players(players, orders["players"])
    m = m.drop(*[c for c in p.columns if c != "match_id"])
    t = t.drop(*[c for c in {*p.columns, *m.columns} if c not in ("match_id", "map")])
    df = many_to_one(p, m, ["match_id"], check=False).dropna(subset=["match_id", "team_id", "map"])
    # A match's maps come as one row, so that this join too goes by match, as the rows lie already.
    at = [c for c in t.columns if c not in ("match_id", "map")]
    t = t.where("map is not null").groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("map", F.struct(*at)))).alias("_maps"))
    df = many_to_one(df, t, ["match_id"], check=False).withColumn("_map", F.col("_maps")[F.col("map")])
    df = df.select(*[c for c in df.columns if c not in ("_maps", "_map")], *[F.col(f"_map.{c}").alias(c) for c in at])
    df = df.withColumns(
        {
            "opponent_team_id": other_side("team_id", "team_1_id", F.col("team_1_id"), F.col("team_2_id")),
            "opponent_team": other_side("team_id", "team_1_id", F.col("team_1"), F.col("team_2")),
            "ts": match_timestamp("match_date", "match_time" if "match_time" in df.columns else None),
        }
    )
    if elo:
        df = add_elo(df, rate_maps(map_results(df), pool))
    kept = [c for c in [*KEPT, *NUMBERS, *SHARES, "kda_all"] if c in df.columns]
    return df.dropna(subset=REQUIRED).select(kept)


def as_fact(df: DataFrame) -> DataFrame:
    """The dataset with the short metric names that the features use."""
    return df.withColumnsRenamed({"rating2_all": "rating", "acs_all": "acs", "kda_all": "kda"})
