"""Queries of the point-in-time features, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import calendar, stage_importance
from ..operators import elo, features, forecast, pit, rerun, splits, views
from ..operators.graph import shared_folder
from .fact import TYPE_ROLES, barrier_sql, entry_sql, fact, with_fact

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["player_id", "match_id", "map"]


# Means of whole numbers are equal to the last bit; what isn't is compared rounded.
INEXACT = ("_std", "_ewm_", "_gap", "_trend", "elo", "synergy", "schedule", "_share", "continuity")


def rounded(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    one = lambda c: F.round(F.col(c), 4) if any(x in c for x in INEXACT) else F.col(c).cast("double")
    return df.select(*keep, *[one(c).alias(c) for c in columns])


def _sql_rounded(inner: str, keep: list[str], columns: list[str], *more: str) -> str:
    one = lambda c: f"round({c}, 4)" if any(x in c for x in INEXACT) else f"{c}::DOUBLE"
    cols = ", ".join([*keep, *[f"{one(c)} AS {c}" for c in columns]])
    return with_fact(f"SELECT {cols} FROM ({inner})", *more)


def simple(name: str, keys: list[str], feats: dict[str, tuple]) -> None:
    """A query whose features are all frames of one key. feats: name to (maker of the aggregate, n, SQL)."""
    QUERIES[name] = lambda spark, d: rounded(pit.barrier(fact(spark, d), keys, {k: (a(), n) for k, (a, n, _) in feats.items()}), KEY, list(feats))
    ORACLE_SQL[name] = _sql_rounded(barrier_sql(", ".join(keys), {k: (s, n) for k, (_, n, s) in feats.items()}), KEY, list(feats))


def mean(c: str, n: int) -> tuple:
    return lambda: F.avg(c), n, f"avg({c})"


def count(n: int | None) -> tuple:
    return lambda: F.count(F.lit(1)), n, "count(*)"


P = {"rating": "player_rating", "acs": "player_acs", "kda": "player_kda"}
simple("w2_last_n_means", ["player_id"], {f"{p}_last_{n}": mean(c, n) for c, p in P.items() for n in (3, 5, 10)})
simple("w4_deviation_w6_long_term", ["player_id"], {"player_rating_std": (lambda: F.stddev_samp("rating"), 500, "stddev_samp(rating)")} | {f"{p}_long_term": mean(c, 500) for c, p in P.items()})
simple("w12_map_history", ["player_id", "map"], {"player_map_rating_last_3": mean("rating", 3), "player_map_acs_last_5": mean("acs", 5), "player_map_kda_last_5": mean("kda", 5), "player_map_matches_played": count(100)})
simple("w13_agent_history", ["player_id", "agent"], {f"player_agent_{c}_last_5": mean(c, 5) for c in P} | {"player_agent_matches_played": count(100)})
simple("w15_agent_map_history", ["player_id", "agent", "map"], {"player_agent_map_rating_last_5": mean("rating", 5)})
simple("w15_role_map_history", ["player_id", "role", "map"], {"player_role_map_rating_last_5": mean("rating", 5)})
simple("w20_opponent_history", ["player_id", "opponent_team_id"], {"player_opponent_rating_last_5": mean("rating", 5), "player_opponent_matches_played": count(100)})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


LAST = {"player_rating_last": ("last_value(rating)", 1)}


@query("w1_last_values", with_fact("SELECT a.player_id, a.match_id, a.map, a.player_rating_last, b.player_map_rating_last FROM a JOIN b USING (player_id, match_id, map)", "a AS (" + barrier_sql("player_id", LAST) + ")", "b AS (" + barrier_sql("player_id, map", {"player_map_rating_last": ("last_value(rating)", 1)}) + ")"))
def w1(spark, d):
    out = pit.barrier(fact(spark, d), ["player_id"], {"player_rating_last": (F.last("rating"), 1)})
    return pit.barrier(out, ["player_id", "map"], {"player_map_rating_last": (F.last("rating"), 1)}).select(*KEY, "player_rating_last", "player_map_rating_last")


EWM = [f"{p}_ewm_{s}" for p in P.values() for s in (3, 5, 10)]
_fold = lambda c, s: f"list_reduce(list_filter(h_{c}, lambda x: x IS NOT NULL), lambda a, x: a + (2.0 / {s + 1}) * (x - a))"


@query(
    "w3_ewm_w7_form_gap",
    with_fact(
        "SELECT player_id, match_id, map, " + ", ".join(f"round({e}, 4) AS {e}" for e in EWM) + ", " + ", ".join(f"round({p}_ewm_5 - {p}_lt, 4) AS {p}_form_gap" for p in P.values())
        + " FROM (SELECT *, " + ", ".join(f"CASE WHEN len(list_filter(h_{c}, lambda x: x IS NOT NULL)) > 0 THEN {_fold(c, s)} END AS {p}_ewm_{s}" for c, p in P.items() for s in (3, 5, 10)) + " FROM hist)",
        "hist AS (" + barrier_sql("player_id", {f"h_{c}": (f"list({c})", 500) for c in P} | {f"{p}_lt": (f"avg({c})", 500) for c, p in P.items()}) + ")",
    ),
)
def w3(spark, d):
    df = pit.barrier(fact(spark, d), ["player_id"], {f"{p}_long_term": (F.avg(c), pit.HISTORY) for c, p in P.items()})
    return rounded(features.form(df), KEY, [*EWM, *[f"{p}_form_gap" for p in P.values()]])


@query(
    "w5_form_trend",
    with_fact(
        "SELECT player_id, match_id, map, round(coalesce(CASE WHEN len(v) >= 2 THEN list_sum(list_transform(v, lambda x, i: (i - 1 - (len(v) - 1) / 2.0) * x)) / (len(v) * (len(v) * len(v) - 1) / 12.0) ELSE 0.0 END, 0.0), 4) AS player_form_trend"
        " FROM (SELECT *, list_filter(h, lambda x: x IS NOT NULL) AS v FROM hist)",
        "hist AS (" + barrier_sql("player_id", {"h": ("list(rating)", 5)}) + ")",
    ),
)
def w5(spark, d):
    df = pit.barrier(fact(spark, d), ["player_id"], {"v": (pit.values_in("rating"), 5)})
    return rounded(df.withColumn("player_form_trend", pit.slope_of(F.col("v"))), KEY, ["player_form_trend"])


@query(
    "w8_matches_played",
    with_fact(
        "SELECT player_id, match_id, map, coalesce(player_matches_played, 0)::BIGINT AS player_matches_played FROM (" + barrier_sql("player_id", {"player_matches_played": ("sum(new)", None)}, "flagged") + ")",
        "flagged AS (SELECT *, (row_number() OVER (PARTITION BY player_id, match_id ORDER BY ts, match_id, map) = 1)::INT AS new FROM fact)",
    ),
)
def w8(spark, d):
    return pit.distinct_before(fact(spark, d), ["player_id"], "match_id", "player_matches_played").select(*KEY, "player_matches_played")


@query("w9_sample_size", with_fact("SELECT player_id, match_id, map, least(n, 500)::DOUBLE AS player_history_sample_size, (n = 0)::INT::DOUBLE AS player_cold_start FROM (" + barrier_sql("player_id", {"n": ("count(*)", None)}) + ")"))
def w9(spark, d):
    return features.player_history(fact(spark, d)).select(*KEY, "player_history_sample_size", "player_cold_start")


@query("w10_rest_days", with_fact("SELECT player_id, match_id, map, CASE WHEN p IS NOT NULL THEN round(greatest(epoch_us(ts) - epoch_us(p), 0) / 86400e6, 4) END AS player_rest_days FROM (" + barrier_sql("player_id", {"p": ("last_value(ts)", 1)}, keep="player_id, match_id, map, ts") + ")"))
def w10(spark, d):
    return rounded(pit.rest_days(fact(spark, d), ["player_id"]), KEY, ["player_rest_days"])


@query(
    "w11_recent_matches",
    with_fact(
        "SELECT player_id, match_id, map, "
        + ", ".join(f"count(DISTINCT match_id) OVER (PARTITION BY player_id ORDER BY ts RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)::DOUBLE AS player_matches_last_{n}d" for n in (7, 14, 30))
        + " FROM fact"
    ),
)
def w11(spark, d):
    return pit.distinct_in_days(fact(spark, d), ["player_id"], "match_id", [7, 14, 30], "player_matches_last_").select(*KEY, *[f"player_matches_last_{n}d" for n in (7, 14, 30)])


ROLE = [f"player_role_{c}_last_5" for c in P]


@query(
    "w14_role_history",
    with_fact(
        "SELECT player_id, match_id, map, " + ", ".join(f"round({c}, 4) AS {c}" for c in ROLE) + ", player_role_matches_played, round(player_role_matches_played / greatest(a.n, 1), 4) AS player_role_share FROM r JOIN a USING (player_id, match_id, map)",
        "r AS (" + barrier_sql("player_id, role", {f"player_role_{c}_last_5": (f"avg({c})", 5) for c in P} | {"player_role_matches_played": ("count(*)", 100)}) + ")",
        "a AS (" + barrier_sql("player_id", {"n": ("count(*)", 100)}) + ")",
    ),
)
def w14(spark, d):
    out = features.context_history(fact(spark, d))
    return out.select(*KEY, *[F.round(c, 4).alias(c) for c in ROLE], "player_role_matches_played", F.round("player_role_share", 4).alias("player_role_share"))


TEAMS = """teams AS (SELECT * REPLACE (CASE WHEN entry THEN won END AS won), CASE WHEN entry THEN roster END AS eroster FROM (
  SELECT match_id, map, team_id, min(ts) AS ts, min(opponent_team_id) AS opponent_team_id, avg(rating) AS rating, avg(acs) AS acs, avg(kda) AS kda,
  max(CASE WHEN map_winner = team THEN 1.0::DOUBLE WHEN map_winner = opponent_team THEN 0.0 END) AS won, list_sort(list(DISTINCT player_id)) AS roster,
  coalesce(avg(rating), avg(acs), avg(kda)) IS NOT NULL AS entry, true AS present FROM fact WHERE team_id IS NOT NULL GROUP BY match_id, map, team_id
  UNION ALL BY NAME
  SELECT match_id, map, opponent_team_id AS team_id, min(ts) AS ts, false AS entry, false AS present FROM fact f WHERE opponent_team_id IS NOT NULL
  AND NOT EXISTS (FROM fact o WHERE o.match_id = f.match_id AND o.map = f.map AND o.team_id = f.opponent_team_id) GROUP BY match_id, map, opponent_team_id))"""
TKEY = ["match_id", "map", "team_id"]
T16 = ["team_rating_last_5", "team_rating_last_10", "team_acs_last_5", "team_kda_last_5"]
T17 = ["team_map_win_rate", "team_map_matches", "team_map_rating_last_5"]
TH = "th AS (" + entry_sql("team_id", {"team_rating_last_5": ("avg(rating)", 5), "team_rating_last_10": ("avg(rating)", 10), "team_acs_last_5": ("avg(acs)", 5), "team_kda_last_5": ("avg(kda)", 5), "before": ("max(eroster)", 1), "latest": ("max(rating)", 1), "n": ("sum(entry::INT)", 100)}, "teams", "match_id, map, team_id, opponent_team_id, ts, roster, present") + ")"
TM = "tm AS (" + entry_sql("team_id, map", {"team_map_win_rate": ("avg(won)", 100), "team_map_matches": ("count(won)", 100), "team_map_rating_last_5": ("avg(rating)", 5)}, "teams", "match_id, map, team_id") + ")"


@query("a1_team_maps", with_fact("SELECT match_id, map, team_id, round(rating, 4) AS rating, round(acs, 4) AS acs, round(kda, 4) AS kda, won, len(roster)::INT AS players FROM teams WHERE entry", TEAMS))
def a1(spark, d):
    t = features.team_maps(fact(spark, d)).where("entry")
    return t.select(*TKEY, *[F.round(c, 4).alias(c) for c in P], "won", F.size("roster").alias("players"))


@query(
    "w16_team_history",
    with_fact(
        "SELECT f.player_id, f.match_id, f.map, " + ", ".join(f"o.{c}::DOUBLE AS {c}" for c in T16) + ", " + ", ".join(f"x.{c}::DOUBLE AS {c.replace('team_', 'opponent_')}" for c in T16)
        + " FROM fact f LEFT JOIN th o USING (match_id, map, team_id) LEFT JOIN th x ON x.match_id = f.match_id AND x.map = f.map AND x.team_id = f.opponent_team_id",
        TEAMS, TH,
    ),
)
def w16(spark, d):
    f = fact(spark, d)
    out = features.add_team_features(f, features.team_history(features.team_maps(f)))
    return rounded(out, KEY, [*T16, *[c.replace("team_", "opponent_") for c in T16]])


@query(
    "w17_map_win_rates_w18_strength",
    with_fact(
        "SELECT f.player_id, f.match_id, f.map, " + ", ".join(f"o.{c}::DOUBLE AS {c}" for c in T17) + ", x.team_map_win_rate::DOUBLE AS opponent_map_win_rate, coalesce(x.team_map_matches, 0)::DOUBLE AS opponent_map_matches, x.team_map_rating_last_5::DOUBLE AS opponent_map_strength"
        " FROM fact f LEFT JOIN tm o USING (match_id, map, team_id) LEFT JOIN tm x ON x.match_id = f.match_id AND x.map = f.map AND x.team_id = f.opponent_team_id",
        TEAMS, TM,
    ),
)
def w17(spark, d):
    f = fact(spark, d)
    return rounded(features.add_team_features(f, features.team_history(features.team_maps(f))), KEY, [*T17, "opponent_map_win_rate", "opponent_map_matches", "opponent_map_strength"])


@query(
    "w19_schedule_strength",
    with_fact(
        "SELECT match_id, map, team_id, round(s, 4) AS team_strength_of_schedule FROM (" + entry_sql("team_id", {"s": ("avg(faced)", 10)}, "f2", "match_id, map, team_id, present") + ") WHERE present",
        TEAMS, TH, "f2 AS (SELECT t.*, CASE WHEN t.entry THEN o.latest END AS faced FROM teams t LEFT JOIN th o ON o.match_id = t.match_id AND o.map = t.map AND o.team_id = t.opponent_team_id)",
    ),
)
def w19(spark, d):
    return rounded(features.schedule_strength(features.team_history(features.team_maps(fact(spark, d)))).where("present"), TKEY, ["team_strength_of_schedule"])


@query(
    "w21_role_matchup",
    with_fact(
        "SELECT player_id, match_id, map, round(m, 4) AS role_matchup_rating_last_5, n AS role_matchup_matches_played FROM (" + barrier_sql("role", {"m": ("avg(rating)", 5), "n": ("count(*)", 100)}, order="match_id, map, player_id") + ")"
    ),
)
def w21(spark, d):
    out = features.add_role_matchup(fact(spark, d))
    return out.select(*KEY, F.round("role_matchup_rating_last_5", 4).alias("role_matchup_rating_last_5"), "role_matchup_matches_played")


@query("w22_elo_confidence", with_fact("SELECT match_id, map, team_id, round(least(1.0, sqrt(coalesce(n, 0)) / sqrt(10.0)), 4) AS team_elo_confidence FROM th WHERE present", TEAMS, TH))
def w22(spark, d):
    t = features.team_history(features.team_maps(fact(spark, d))).where("present")
    return rounded(t.withColumn("team_elo_confidence", F.least(F.lit(1.0), F.sqrt("team_count") / F.sqrt(F.lit(10.0)))), TKEY, ["team_elo_confidence"])


@query("w23_lineup_continuity", with_fact("SELECT match_id, map, team_id, CASE WHEN before IS NOT NULL THEN round(len(list_intersect(roster, before)) / len(roster), 4) END AS lineup_continuity FROM th WHERE present", TEAMS, TH))
def w23(spark, d):
    return rounded(features.team_history(features.team_maps(fact(spark, d))).where("present"), TKEY, ["lineup_continuity"])


SHARES = [f"team_role_{r.lower()}_share" for r in features.ROLES]


@query(
    "w24_roster_features",
    with_fact(
        "SELECT match_id, map, team_id, sum((anyp > 0)::INT)::DOUBLE AS veterans_remaining, " + ", ".join(f"round(avg((role = '{r}')::INT), 4) AS team_role_{r.lower()}_share" for r in features.ROLES)
        + ", round(sum(s) / nullif(sum(c), 0), 4) AS team_roster_synergy FROM past GROUP BY ALL",
        "past AS (" + barrier_sql("player_id", {"s": ("sum(rating)", 500), "c": ("count(rating)", 500), "anyp": ("count(*)", 1)}, keep="match_id, map, team_id, role") + ")",
    ),
)
def w24(spark, d):
    out = features.add_roster_features(fact(spark, d)).dropDuplicates(TKEY)
    return out.select(*TKEY, "veterans_remaining", *[F.round(c, 4).alias(c) for c in [*SHARES, "team_roster_synergy"]])


def _level(name: str, keys: str, c: str) -> str:
    return f"{name}_{c} AS (" + barrier_sql(keys, {"v": (f"avg({c})", 5)}) + ")"


FB = [_level(n, k, c) for c in P for n, k in (("m", "player_id, map"), ("a", "player_id, agent"), ("r", "player_id, role"), ("p", "player_id"))]
_steps = lambda c: [f"m_{c}.v", f"a_{c}.v", f"r_{c}.v", f"p_{c}.v", "o.team_rating_last_5", "x.team_rating_last_5"]
FALL = [f"player_{c}_fallback" for c in P]


@query(
    "w27_fallback",
    with_fact(
        "SELECT f.player_id, f.match_id, f.map, " + ", ".join(f"round(coalesce({', '.join(_steps(c))}), 4) AS player_{c}_fallback" for c in P)
        + ", CASE " + " ".join(f"WHEN {s} IS NOT NULL THEN '{n}'" for n, s in zip(features.LEVELS, _steps("rating"), strict=True)) + " ELSE 'global-mean' END AS form_fallback_level FROM fact f "
        + " ".join(f"JOIN {n}_{c} USING (player_id, match_id, map)" for c in P for n in "marp")
        + " LEFT JOIN th o ON o.match_id = f.match_id AND o.map = f.map AND o.team_id = f.team_id LEFT JOIN th x ON x.match_id = f.match_id AND x.map = f.map AND x.team_id = f.opponent_team_id",
        *FB, TEAMS, TH,
    ),
)
def w27(spark, d):
    out = features.add_team_features(splits.checkpointed(fact(spark, d)))  # first, while rows are narrow
    return features.add_fallback(features.context_history(features.player_history(out))).select(*KEY, *[F.round(c, 4).alias(c) for c in FALL], "form_fallback_level")


STAGES = ["Group Stage", "Upper Bracket", "Grand Final", "Swiss", "Regular Season Final", "Showmatch"]
ROUNDS = ["", "Final", "Lower Semi", "Championship", "Group A", "Day 1"]
WEIGHTS = "[0.4, 0.8, 1.0, 0.4, 0.4, 0.5]", "[0.5, 1.0, 0.8, 1.0, 0.4, 0.5]"  # of each stage and each round alone


@query(
    "w28_calendar_p8_importance",
    with_fact(
        "SELECT player_id, match_id, map, year(ts)::DOUBLE AS match_year, month(ts)::DOUBLE AS match_month, (isodow(ts) - 1)::DOUBLE AS match_dayofweek, "
        f"(CASE WHEN list_contains([s, r], 0.4) THEN 0.4 WHEN list_contains([s, r], 0.8) THEN 0.8 ELSE greatest(s, r) END)::DOUBLE AS match_importance "
        f"FROM (SELECT *, ({WEIGHTS[0]})[(match_id % 6 + 1)::INT] AS s, ({WEIGHTS[1]})[(player_id % 6 + 1)::INT] AS r FROM fact)"
    ),
)
def w28(spark, d):
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col(by) % 6 + 1).cast("int"))
    weight = stage_importance(pick(STAGES, "match_id"), pick(ROUNDS, "player_id"))
    return fact(spark, d).select(*KEY, *[c.alias(n) for n, c in calendar("ts").items()], weight.alias("match_importance"))


@query("w29_elo")
def w29(spark, d):
    f = fact(spark, d)
    one = F.concat(F.lit("team"), F.col("team_1_id").cast("string"))
    maps = f.dropDuplicates(["match_id", "map"]).withColumn("result", F.when(F.col("map_winner") == "Draw", 0.5).when(F.col("map_winner") == one, 1.0).otherwise(0.0))
    return rounded(elo.rate_maps(maps), ["match_id", "map"], ["elo_1", "elo_2"])


@query("w32_time_quartiles", with_fact("SELECT player_id, match_id, map, greatest(0, ceil((r - 1) * 4.0 / (n - 1)) - 1)::INT AS time_period FROM (SELECT *, row_number() OVER (ORDER BY ts, match_id, map, player_id) AS r, count(*) OVER () AS n FROM fact)"))
def w32(spark, d):
    return splits.time_periods(fact(spark, d), ["ts", "match_id", "map", "player_id"]).select(*KEY, "time_period")


LAST_MAPS = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY ts DESC, match_id DESC, map DESC) AS r FROM {1}"
STATE = ["player_rating_last_5", "player_map_rating_last_3", "player_opponent_rating_last_5", "player_history_sample_size", "team_rating_last_5", "team_map_win_rate",
         "opponent_rating_last_5", "opponent_rating_last_10", "opponent_acs_last_5", "opponent_map_win_rate", "opponent_map_matches", "opponent_map_strength"]


def _latest(name: str, keys: str, source: str, feats: dict[str, str]) -> str:
    return f"{name} AS (SELECT {keys}, " + ", ".join(f"{x} AS {k}" for k, x in feats.items()) + " FROM (" + LAST_MAPS.format(keys, source) + ") GROUP BY ALL)"


@query(
    "m20_request_state_j11",
    with_fact(
        "SELECT q.player_id, q.map, q.opponent_team_id, " + ", ".join(f"round({'coalesce(xm.opponent_map_matches, 0)' if c == 'opponent_map_matches' else c}, 4)::DOUBLE AS {c}" for c in STATE)
        + " FROM (" + LAST_MAPS.format("player_id", "fact") + ") q LEFT JOIN p USING (player_id) LEFT JOIN pm USING (player_id, map) LEFT JOIN po USING (player_id, opponent_team_id)"
        " LEFT JOIN o USING (team_id) LEFT JOIN om USING (team_id, map) LEFT JOIN x ON x.team_id = q.opponent_team_id LEFT JOIN xm ON xm.team_id = q.opponent_team_id AND xm.map = q.map WHERE q.r = 1",
        TEAMS, "played AS (FROM teams WHERE entry)",
        _latest("p", "player_id", "fact", {"player_rating_last_5": "avg(rating) FILTER (r <= 5)", "player_history_sample_size": "least(count(*), 500)"}),
        _latest("pm", "player_id, map", "fact", {"player_map_rating_last_3": "avg(rating) FILTER (r <= 3)"}),
        _latest("po", "player_id, opponent_team_id", "fact", {"player_opponent_rating_last_5": "avg(rating) FILTER (r <= 5)"}),
        _latest("o", "team_id", "played", {"team_rating_last_5": "avg(rating) FILTER (r <= 5)"}),
        _latest("om", "team_id, map", "played", {"team_map_win_rate": "avg(won) FILTER (r <= 100)"}),
        _latest("x", "team_id", "played", {"opponent_rating_last_5": "avg(rating) FILTER (r <= 5)", "opponent_rating_last_10": "avg(rating) FILTER (r <= 10)", "opponent_acs_last_5": "avg(acs) FILTER (r <= 5)"}),
        _latest("xm", "team_id, map", "played", {"opponent_map_win_rate": "avg(won) FILTER (r <= 100)", "opponent_map_matches": "count(won) FILTER (r <= 100)", "opponent_map_strength": "avg(rating) FILTER (r <= 5)"}),
    ),
)
def m20(spark, d):
    """The state that forecasts of every player's next map rest on; no request has a row of the opponent beside it."""
    history = fact(spark, d)
    out = forecast.inference_state(views.next_requests(history, "2030-01-01 00:00:00"), history, TYPE_ROLES)
    return out.select("player_id", "map", "opponent_team_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in STATE])


def _from(name: str, *columns: str) -> tuple[str, list[str]]:
    return name, [c for x in columns for c in ([x] if isinstance(x, str) else x)]


MEANS = [f"{p}_last_{n}" for p in P.values() for n in (3, 5, 10)]
PARTS = [
    _from("w2_last_n_means", *MEANS),
    _from("w4_deviation_w6_long_term", "player_rating_std", *[f"{p}_long_term" for p in P.values()]),
    _from("w12_map_history", "player_map_rating_last_3", "player_map_acs_last_5", "player_map_kda_last_5", "player_map_matches_played"),
    _from("w13_agent_history", *[f"player_agent_{c}_last_5" for c in P], "player_agent_matches_played"),
    _from("w15_agent_map_history", "player_agent_map_rating_last_5"),
    _from("w15_role_map_history", "player_role_map_rating_last_5"),
    _from("w20_opponent_history", "player_opponent_rating_last_5", "player_opponent_matches_played"),
    _from("w1_last_values", "player_rating_last", "player_map_rating_last"),
    _from("w3_ewm_w7_form_gap", *EWM, *[f"{p}_form_gap" for p in P.values()]),
    _from("w5_form_trend", "player_form_trend"),
    _from("w8_matches_played", "player_matches_played"),
    _from("w9_sample_size", "player_history_sample_size", "player_cold_start"),
    _from("w10_rest_days", "player_rest_days"),
    _from("w11_recent_matches", *[f"player_matches_last_{n}d" for n in (7, 14, 30)]),
    _from("w14_role_history", *ROLE, "player_role_matches_played", "player_role_share"),
    _from("w16_team_history", *T16, *[c.replace("team_", "opponent_") for c in T16]),
    _from("w17_map_win_rates_w18_strength", *T17, "opponent_map_win_rate", "opponent_map_matches", "opponent_map_strength"),
    _from("w19_schedule_strength", "team_strength_of_schedule"),
    _from("w21_role_matchup", "role_matchup_rating_last_5", "role_matchup_matches_played"),
    _from("w23_lineup_continuity", "lineup_continuity"),
    _from("w24_roster_features", "veterans_remaining", *SHARES, "team_roster_synergy"),
    _from("w27_fallback", *FALL),
    _from("w28_calendar_p8_importance", "match_year", "match_month", "match_dayofweek"),
]
FEATURES = [c for _, columns in PARTS for c in columns]
OF_TEAM = ("w19_schedule_strength", "w23_lineup_continuity", "w24_roster_features")
#: SQL of all features: that of each part, joined by player row or by team.
ALL_SQL = (
    "SELECT f.player_id, f.match_id, f.map, " + ", ".join(f"round({c}::DOUBLE, 4) AS {c}" for c in FEATURES) + ", form_fallback_level FROM (" + with_fact("SELECT player_id, match_id, map, team_id FROM fact") + ") f "
    + " ".join(f"LEFT JOIN ({ORACLE_SQL[n]}) p{i} ON p{i}.match_id = f.match_id AND p{i}.map = f.map AND " + (f"p{i}.team_id = f.team_id" if n in OF_TEAM else f"p{i}.player_id = f.player_id") for i, (n, _) in enumerate(PARTS))
)


@query("build_features", ALL_SQL)
def everything(spark, d):
    out = features.build_features(fact(spark, d))
    return out.select(*KEY, *[F.round(F.col(c).cast("double"), 4).alias(c) for c in FEATURES], "form_fallback_level")


LATE = ["player_rating_last_5", "player_rating_long_term", "team_rating_last_5", "opponent_rating_last_5", "opponent_map_win_rate", "team_roster_synergy", "team_strength_of_schedule", "role_matchup_rating_last_5"]


@query(
    "late_rows_rerun",
    "SELECT f.player_id, f.match_id, f.map, " + ", ".join(f"round({c}::DOUBLE, 4) AS {c}" for c in LATE) + " FROM (" + with_fact("SELECT player_id, match_id, map, team_id FROM fact") + ") f "
    + " ".join(f"LEFT JOIN ({ORACLE_SQL[n]}) p{i} ON p{i}.match_id = f.match_id AND p{i}.map = f.map AND " + (f"p{i}.team_id = f.team_id" if n in OF_TEAM else f"p{i}.player_id = f.player_id") for i, (n, cs) in enumerate(PARTS) if set(cs) & set(LATE)),
)
def late(spark, d):
    """Features built without some rows of the last quarter, then rerun for what these reach: as if they had been there."""
    whole = splits.checkpointed(fact(spark, d))
    end = whole.agg(F.max("ts")).first()[0]
    is_late = (F.col("ts") > F.lit(end) - F.expr("INTERVAL 90 DAYS")) & (F.col("match_id") % 7 == 0)
    before, rows = whole.where(~is_late), whole.where(is_late)
    month = lambda df: df.withColumn("part", F.date_format("ts", "yyyyMM"))
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    month(features.build_features(before)).write.partitionBy("part").parquet(path)
    changes, now = rerun.change_set(before, rows), rerun.with_rows(before, rows)
    rerun.replace_rows(path, month(rerun.rerun_features(now, changes, spark.read.parquet(path))), changes, "part")
    return spark.read.parquet(path).select(*KEY, *[F.round(c, 4).alias(c) for c in LATE])
