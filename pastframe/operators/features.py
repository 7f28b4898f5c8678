"""The historical feature table: entity, team, opponent and roster history before each row's timestamp.

Rows hold player_id, match_id, map, ts, team_id, opponent_team_id, agent, role,
rating, acs, kda, map_winner (a team name) and team (the own full name),
opponent_team. All functions return their input with columns added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import calendar
from . import pit
from .graph import checkpointed
from .joins import check_unique
from .pit import barrier, distinct_before, entry_barrier

METRICS = {"rating": "player_rating", "acs": "player_acs", "kda": "player_kda"}
TEAM_CAP = KEY_CAP = 100
ROLES = ["Duelist", "Initiator", "Controller", "Sentinel"]  # fixed values
SPANS = [3, 5, 10]
EWM = [f"{p}_ewm_{s}" for p in METRICS.values() for s in SPANS]
FEW = 100_000  # rows of a counted table that are broadcast, at most


def player_history(df: DataFrame) -> DataFrame:
    """Last values, means, deviation, trend, long-term means, counts, rest and recent workload of the player."""
    k = ["player_id"]
    f: dict[str, tuple[Column, int | None]] = {"player_rating_last": (F.last("rating"), 1)}
    for c, p in METRICS.items():
        f |= {f"{p}_last_{n}": (F.avg(c), n) for n in (3, 5, 10)}
        f[f"{p}_long_term"] = (F.avg(c), pit.HISTORY)
    f["player_rating_std"] = (F.stddev_samp("rating"), pit.HISTORY)
    f["_recent"] = (F.collect_list("rating"), 5)
    f["_n"] = (F.count(F.lit(1)), None)
    f["_prev"] = (F.last("ts"), 1)
    out = barrier(df, k, f)
    out = out.withColumns(
        {
            "player_form_trend": pit.slope_of(F.col("_recent")),
            "player_history_sample_size": F.least("_n", F.lit(pit.HISTORY)).cast("double"),
            "player_cold_start": (F.col("_n") == 0).cast("double"),
            "player_rest_days": pit.days_between("_prev", "ts"),
        }
    ).drop("_recent", "_n", "_prev")
    out = distinct_before(out, k, "match_id", "player_matches_played")
    return pit.distinct_in_days(out, k, "match_id", [7, 14, 30], "player_matches_last_")


def ewm(df: DataFrame) -> DataFrame:
    """The exponentially weighted means of ``form``: a scan in Python, through which all columns go, so best on few."""
    return pit.ewm(df, "player_id", METRICS, SPANS)


def form(df: DataFrame) -> DataFrame:
    """Exponentially weighted means, unless ``df`` has them, and their gap to the long term (needs ``player_history``)."""
    out = df if set(EWM) <= set(df.columns) else ewm(df)
    return out.withColumns({f"{p}_form_gap": F.col(f"{p}_ewm_5") - F.col(f"{p}_long_term") for p in METRICS.values()})


def context_history(df: DataFrame) -> DataFrame:
    """The player's history on the map, agent, role and their pairs, and against the opponent team."""
    capped = lambda: (F.count(F.lit(1)), KEY_CAP)
    out = barrier(
        df,
        ["player_id", "map"],
        {
            "player_map_rating_last": (F.last("rating"), 1),
            "player_map_rating_last_3": (F.avg("rating"), 3),
            "player_map_rating_last_5": (F.avg("rating"), 5),
            "player_map_acs_last_5": (F.avg("acs"), 5),
            "player_map_kda_last_5": (F.avg("kda"), 5),
            "player_map_matches_played": capped(),
        },
    )
    for key in ("agent", "role"):
        p = f"player_{key}"
        f = {f"{p}_{c}_last_5": (F.avg(c), 5) for c in METRICS}
        out = barrier(out, ["player_id", key], f | {f"{p}_matches_played": capped()})
        out = barrier(out, ["player_id", key, "map"], {f"{p}_map_rating_last_5": (F.avg("rating"), 5)})
    out = barrier(out, ["player_id"], {"_all": capped()})
    out = out.withColumn("player_role_share", F.col("player_role_matches_played") / F.greatest("_all", F.lit(1))).drop("_all")
    return barrier(
        out,
        ["player_id", "opponent_team_id"],
        {"player_opponent_rating_last_5": (F.avg("rating"), 5), "player_opponent_matches_played": capped()},
    )


def team_maps(df: DataFrame) -> DataFrame:
    """One row per (match, map, team), for both sides of a map: mean metrics, whether it won, its roster.

    A group without any metric, such as a future map, is no ``entry``. A team that
    a map names only as the opponent is not ``present``: it has a row that asks for
    its history at that time, so that one-sided tables find both teams' state.
    """
    won = F.when(F.col("map_winner") == F.col("team"), 1.0).when(F.col("map_winner") == F.col("opponent_team"), 0.0)
    own = df.where("team_id is not null").select(
        "match_id", "map", "team_id", "ts", "opponent_team_id", *METRICS, won.alias("won"), "player_id", F.lit(1).alias("here")
    )
    asking = df.where("opponent_team_id is not null").select("match_id", "map", F.col("opponent_team_id").alias("team_id"), "ts", F.lit(0).alias("here"))
    t = own.unionByName(asking, allowMissingColumns=True).groupBy("match_id", "map", "team_id").agg(
        F.min("ts").alias("ts"),
        F.min("opponent_team_id").alias("opponent_team_id"),
        *[F.avg(c).alias(c) for c in METRICS],
        F.max("won").alias("won"),
        F.array_sort(F.collect_set("player_id")).alias("roster"),
        (F.max("here") == 1).alias("present"),
    )
    t = t.withColumn("entry", F.expr("coalesce(rating, acs, kda) is not null"))
    return t.withColumn("won", F.when(F.col("entry"), F.col("won")))


def team_history(teams: DataFrame) -> DataFrame:
    """Team and (team, map) history on the table of ``team_maps``."""
    past = lambda c: F.max(F.when(F.col("entry"), F.col(c)))  # noqa: E731  of a single entry
    t = entry_barrier(
        teams,
        ["team_id"],
        "entry",
        {
            "team_rating_last_5": (F.avg("rating"), 5),
            "team_rating_last_10": (F.avg("rating"), 10),
            "team_acs_last_5": (F.avg("acs"), 5),
            "team_kda_last_5": (F.avg("kda"), 5),
            "team_count": (F.count(F.when(F.col("entry"), 1)), TEAM_CAP),
            "_before": (past("roster"), 1),
            "_latest": (past("rating"), 1),
        },
    )
    t = entry_barrier(
        t,
        ["team_id", "map"],
        "entry",
        {"team_map_win_rate": (F.avg("won"), TEAM_CAP), "team_map_matches": (F.count("won"), TEAM_CAP), "team_map_rating_last_5": (F.avg("rating"), 5)},
    )
    kept = F.size(F.array_intersect("roster", "_before")) / F.size("roster")
    return t.withColumn("lineup_continuity", F.when(F.col("_before").isNotNull() & (F.size("roster") > 0), kept)).drop("_before")


def schedule_strength(teams: DataFrame) -> DataFrame:
    """team_strength_of_schedule: mean over the last 10 maps of the opponent's latest rating before each map (needs ``team_history``)."""
    teams = checkpointed(teams)  # both sides of the join
    other = teams.select("match_id", "map", F.col("team_id").alias("opponent_team_id"), F.col("_latest").alias("_faced"))
    t = teams.join(other, ["match_id", "map", "opponent_team_id"], "left").withColumn("_faced", F.when(F.col("entry"), F.col("_faced")))
    return entry_barrier(t, ["team_id"], "entry", {"team_strength_of_schedule": (F.avg("_faced"), 10)}).drop("_faced")


OWN = ["team_rating_last_5", "team_rating_last_10", "team_acs_last_5", "team_kda_last_5", "team_map_win_rate", "team_map_matches", "team_map_rating_last_5", "team_count", "lineup_continuity", "team_strength_of_schedule"]
OTHER = {
    "team_rating_last_5": "opponent_rating_last_5",
    "team_rating_last_10": "opponent_rating_last_10",
    "team_acs_last_5": "opponent_acs_last_5",
    "team_kda_last_5": "opponent_kda_last_5",
    "team_map_win_rate": "opponent_map_win_rate",
    "team_map_matches": "opponent_map_matches",
    "team_map_rating_last_5": "opponent_map_strength",
}


def add_team_features(df: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Own and opponent team history; the opponent's is read from its row of the same map, which ``team_maps`` gives to both sides.

    A team that is unknown has played no maps. ``teams``: a table of ``team_history`` already made, with or without the strength of schedule.
    """
    t = schedule_strength(team_history(team_maps(df))) if teams is None else teams
    t = checkpointed(t.select("match_id", "map", "team_id", *dict.fromkeys([*(c for c in OWN if c in t.columns), *OTHER])))  # read for both sides
    own = t.select("match_id", "map", "team_id", *[c for c in OWN if c in t.columns])
    other = t.select("match_id", "map", F.col("team_id").alias("opponent_team_id"), *[F.col(a).alias(b) for a, b in OTHER.items()])
    out = df.join(own, ["match_id", "map", "team_id"], "left").join(other, ["match_id", "map", "opponent_team_id"], "left")
    out = out.fillna(0, ["team_map_matches", "opponent_map_matches"])
    sure = F.least(F.lit(1.0), F.sqrt(F.coalesce("team_count", F.lit(0))) / F.sqrt(F.lit(10.0)))
    if "team_elo" in df.columns:
        out = out.withColumn("team_elo_confidence", F.when(F.col("team_elo").isNotNull(), sure))
    return out.drop("team_count")


def add_roster_features(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Veterans, shares of roles and joint history of a team's players on the map. ``rows``: those of ``df`` where they are cheaper to read."""
    past = barrier(df if rows is None else rows, ["player_id"], {"_sum": (F.sum("rating"), pit.HISTORY), "_cnt": (F.count("rating"), pit.HISTORY), "_any": (F.count(F.lit(1)), 1)})
    r = past.groupBy("match_id", "map", "team_id").agg(
        F.sum((F.col("_any") > 0).cast("double")).alias("veterans_remaining"),
        *[(F.sum((F.col("role") == x).cast("double")) / F.count(F.lit(1))).alias(f"team_role_{x.lower()}_share") for x in ROLES],
        (F.sum("_sum") / F.nullif(F.sum("_cnt"), F.lit(0))).alias("team_roster_synergy"),
    )
    return df.join(r, ["match_id", "map", "team_id"], "left")


def add_role_matchup(df: DataFrame, opponent_role: str = "opponent_role", rows: DataFrame | None = None) -> DataFrame:
    """Last-5 mean and capped count per (role, opponent role): few keys with very many rows.

    Entries are reduced to the last five (by a rank limit, which already cuts before
    the shuffle) and a count per (roles, timestamp). Windows then run within each day
    of a pair of roles and over its days, so no task orders all of a pair's rows. ``rows``: those of
    ``df`` where they are cheaper to read.
    """
    known = lambda x: x if opponent_role in x.columns else x.withColumn(opponent_role, F.lit("Flex/Unknown"))
    df, rows = known(df), known(df if rows is None else rows)
    k = ["role", opponent_role]
    place = ["match_id", "map", "player_id"]
    latest = Window.partitionBy(*k, "ts").orderBy(*[F.col(c).desc() for c in place])
    entries = checkpointed(rows.select(*k, "ts", *place, "rating"))  # read twice
    tail = entries.withColumn("_r", F.row_number().over(latest)).where("_r <= 5")
    tail = tail.groupBy(*k, "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), "rating"))), lambda s: s["rating"]).alias("tail"))
    per = entries.groupBy(*k, "ts").agg(F.count(F.lit(1)).alias("n")).join(tail, [*k, "ts"]).withColumn("day", F.to_date("ts"))
    last_five = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - 4), 5)
    before = lambda by, order, n: Window.partitionBy(*by).orderBy(order).rowsBetween(n, -1)
    day, first = [*k, "day"], Window.unboundedPreceding
    per = per.withColumns(
        {
            "_n": F.coalesce(F.sum("n").over(before(day, "ts", first)), F.lit(0)),
            "_t": F.flatten(F.collect_list("tail").over(before(day, "ts", -5))),
        }
    )
    days = per.groupBy(*day).agg(F.sum("n").alias("n"), F.max_by(last_five(F.concat("_t", "tail")), "ts").alias("tail"))
    days = days.select(
        *day,
        F.coalesce(F.sum("n").over(before(k, "day", first)), F.lit(0)).alias("_days_n"),
        F.flatten(F.collect_list("tail").over(before(k, "day", -5))).alias("_days_t"),
    )
    five = F.array_compact(last_five(F.concat("_days_t", "_t")))
    mean = F.when(F.size(five) > 0, F.aggregate(five, F.lit(0.0), lambda a, x: a + x) / F.size(five))
    seen = F.least(F.col("_days_n") + F.col("_n"), F.lit(KEY_CAP))
    got = checkpointed(per.join(days, day).select(*k, "ts", mean.alias("role_matchup_rating_last_5"), seen.alias("role_matchup_matches_played")))
    return df.join(F.broadcast(got) if got.count() <= FEW else got, [*k, "ts"], "left")  # a row for each time of a pair of roles


LEVELS = ["player-map", "player-agent", "player-role", "player-global", "team-context", "opponent-context"]  # fixed values


def add_fallback(df: DataFrame) -> DataFrame:
    """The first known mean of map, agent, role, player, team and opponent, and which it was."""
    steps = lambda c: [f"player_map_{c}_last_5", f"player_agent_{c}_last_5", f"player_role_{c}_last_5", f"player_{c}_last_5", "team_rating_last_5", "opponent_rating_last_5"]
    out = {f"player_{c}_fallback": F.coalesce(*steps(c)) for c in METRICS}
    named = F.lit("global-mean")
    for name, c in reversed(list(zip(LEVELS, steps("rating"), strict=True))):
        named = F.when(F.col(c).isNotNull(), name).otherwise(named)
    return df.withColumns(out | {"form_fallback_level": named})


ENTRY = ["player_id", "match_id", "map"]


def check_entries(df: DataFrame) -> None:
    """Raise if a key has two rows or a row has no timestamp: neither has a place in a history."""
    check_unique(df, ENTRY)
    if lost := df.where("ts is null").count():
        raise ValueError(f"{lost} rows without a timestamp")


def build_features(df: DataFrame, check: bool = True, role_matchup: bool = True) -> DataFrame:
    """All of the above on a cleaned fact table; rows keep their key. Repeated keys and missing timestamps are an error.

    The rows are written once, and every history reads them, not the columns that others added. What
    teams, rosters and pairs of roles know is joined on while rows are narrow; then all of a player's windows
    run after one exchange, so rows with all columns never move.
    """
    rows = checkpointed(df)
    if check:
        check_entries(rows)
    out = add_roster_features(add_team_features(ewm(rows), schedule_strength(team_history(team_maps(rows)))), rows)
    if role_matchup:
        out = add_role_matchup(out, rows=rows)
    out = add_fallback(context_history(form(player_history(out))))
    return out.withColumns(calendar("ts"))
