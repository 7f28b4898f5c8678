"""The features against a sequential walk written from their definitions, and their invariants."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import mean, stdev

import pytest
from pastframe.operators import elo, features, pit
from pastframe.operators.forecast import inference_state

COLUMNS = "player_id long, match_id long, map string, ts timestamp, team_id long, opponent_team_id long, team string, opponent_team string, map_winner string, agent string, role string, role_confidence double, rating double, acs double, kda double"
ROLE = {"jett": "Duelist", "omen": "Controller", "sage": "Sentinel"}


def row(player, match, map_, day, team=10, other=20, agent="jett", rating=1.0, acs=200.0, kda=1.0, winner="A"):
    return (player, match, map_, datetime(2024, 1, 1) + timedelta(days=day), team, other, f"T{team}", f"T{other}", winner, agent, ROLE.get(agent, "Flex/Unknown"), 0.98, rating, acs, kda)


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def rows_of(seed, matches=60):
    r = random.Random(seed)
    out = []
    for m in range(matches):
        day, (a, b) = r.randint(0, 25), r.sample([10, 20, 30], 2)
        for mp in r.sample(["x", "y", "z"], r.randint(1, 2)):
            win = r.choice([f"T{a}", f"T{b}", "Draw", None])
            for team, other in ((a, b), (b, a)):
                for p in r.sample(range(team, team + 4), 2):
                    v = lambda: None if r.random() < 0.2 else float(r.randint(0, 40))
                    out.append(row(p, m, mp, day, team, other, r.choice(list(ROLE)), v(), v(), v(), win))
    return out


def known(xs):
    return [x for x in xs if x is not None]


def avg(xs):
    return mean(known(xs)) if known(xs) else None


def fold(xs, span):
    xs, e = known(xs), None
    for x in xs:
        e = x if e is None else e + 2 / (span + 1) * (x - e)
    return e


def slope(xs):
    xs = known(xs)
    if len(xs) < 2:
        return 0.0
    mx, my = (len(xs) - 1) / 2, mean(xs)
    return sum((i - mx) * (y - my) for i, y in enumerate(xs)) / sum((i - mx) ** 2 for i in range(len(xs)))


def walk(rows):
    """Snapshot all rows of a timestamp, then add them to the state."""
    rows = sorted(rows, key=lambda r: (r[3], r[1], r[2], r[0]))
    hist, maps, out = defaultdict(list), defaultdict(list), {}
    for ts in sorted({r[3] for r in rows}):
        now = [r for r in rows if r[3] == ts]
        for r in now:
            p, m, mp, agent, role, opp = r[0], r[1], r[2], r[9], r[10], r[5]
            h, f = hist[p], {}
            x = [e[12] for e in h]
            f["player_rating_last"] = x[-1] if x else None
            for n in (3, 5, 10):
                f[f"player_rating_last_{n}"], f[f"player_rating_ewm_{n}"] = avg(x[-n:]), fold(x, n)
            f["player_acs_last_5"] = avg([e[13] for e in h][-5:])
            f["player_rating_std"] = stdev(known(x)) if len(known(x)) > 1 else None
            f["player_rating_long_term"], f["player_form_trend"] = avg(x), slope(x[-5:])
            f["player_matches_played"] = len({e[1] for e in h})
            f["player_history_sample_size"], f["player_cold_start"] = float(len(h)), float(not h)
            f["player_rest_days"] = (ts - h[-1][3]).total_seconds() / 86400 if h else None
            f["player_matches_last_7d"] = float(len({e[1] for e in h if e[3] >= ts - timedelta(days=7)}))
            at = lambda k, v, h=h: [e for e in h if e[k] == v]
            f["player_map_rating_last_3"] = avg([e[12] for e in at(2, mp)][-3:])
            f["player_map_matches_played"] = len(at(2, mp))
            f["player_agent_kda_last_5"] = avg([e[14] for e in at(9, agent)][-5:])
            f["player_role_share"] = len(at(10, role)) / max(len(h), 1)
            f["player_opponent_rating_last_5"] = avg([e[12] for e in at(5, opp)][-5:])
            f["player_agent_map_rating_last_5"] = avg([e[12] for e in at(9, agent) if e[2] == mp][-5:])
            for own, name in ((r[4], "team"), (opp, "opponent")):
                seen = maps[own]
                f[f"{name}_rating_last_5"] = avg([e["rating"] for e in seen][-5:])
                here = [e for e in seen if e["map"] == mp]
                f[f"{name}_map_win_rate"], f[f"{name}_map_matches"] = avg([e["won"] for e in here]), float(len(known([e["won"] for e in here])))
            same = [q for q in rows if q[1] == m and q[2] == mp and q[4] == r[4]]
            f["veterans_remaining"] = float(sum(bool(hist[q[0]]) for q in same))
            past = maps[r[4]]
            roster = {q[0] for q in same}
            f["lineup_continuity"] = len(roster & past[-1]["roster"]) / len(roster) if past else None
            out[(p, m, mp)] = f
        groups = defaultdict(list)
        for r in now:
            groups[(r[1], r[2], r[4])].append(r)
            hist[r[0]].append(r)
        for (_, mp, team), g in sorted(groups.items()):
            means = [avg([q[k] for q in g]) for k in (12, 13, 14)]
            if known(means):
                won = 1.0 if g[0][8] == g[0][6] else 0.0 if g[0][8] == g[0][7] else None
                maps[team].append({"map": mp, "rating": means[0], "won": won, "roster": {q[0] for q in g}})
    return out


@pytest.mark.parametrize("seed", [1])
def test_features_equal_the_walk(spark, seed):
    rows = rows_of(seed)
    want = walk(rows)
    random.Random(seed).shuffle(rows)
    got = {(r.player_id, r.match_id, r.map): r for r in features.build_features(table(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for k, f in want.items():
        for name, x in f.items():
            y = got[k][name]
            assert (x is None and y is None) or (x is not None and y is not None and y == pytest.approx(x, abs=1e-9)), (k, name, x, y)


def test_exact_history(spark):
    rows = [row(1, i, "Ascent", i, rating=float(i)) for i in (1, 2, 3)]
    got = {r.match_id: r for r in features.build_features(table(spark, rows)).collect()}
    assert got[1].player_cold_start == 1 and got[1].player_rating_last is None and got[1].form_fallback_level == "global-mean"
    assert got[2].player_rating_last == 1.0 and got[3].player_rating_last_3 == 1.5 and got[3].player_rating_ewm_5 < 2 and got[3].player_matches_played == 2


def test_one_timestamp_sees_nothing_of_itself(spark):
    rows = [row(1, 1, "a", 0), row(1, 2, "b", 0), row(2, 1, "a", 0, 20, 10)]
    assert all(r.player_rating_last is None for r in features.build_features(table(spark, rows)).collect())


def test_the_future_changes_nothing(spark):
    rows = rows_of(5, 25)
    cut = datetime(2024, 1, 14)
    late = [r if r[3] < cut else (*r[:12], 200.0, 200.0, 200.0) for r in rows]
    pick = lambda x: sorted(map(str, features.build_features(table(spark, x)).where(f"ts < '{cut}'").collect()))
    assert pick(rows) == pick(late)


def test_online_equals_offline(spark):
    rows = rows_of(6, 25)
    last = [row(11, 999, "x", 40, 10, 20, "omen", None, None, None, None)]
    offline = features.build_features(table(spark, rows + last)).where("match_id = 999").first().asDict()
    online = inference_state(table(spark, last), table(spark, rows)).first().asDict()
    for k, v in offline.items():
        if k not in ("match_id",):
            assert online[k] == v or online[k] == pytest.approx(v), k


def test_an_opponent_without_a_row_has_its_state(spark):
    """The opponent played four maps, two of them on this one; the request names it only."""
    past = [row(21, m, mp, m, 20, 30, rating=float(m), winner="T20" if m < 3 else "T30") for m, mp in ((1, "x"), (2, "y"), (3, "x"), (4, "y"))]
    asked = [row(11, 999, "x", 40, 10, 20, "omen", None, None, None, None)]
    got = inference_state(table(spark, asked), table(spark, past)).first()
    assert got.opponent_rating_last_5 == 2.5 and got.opponent_map_win_rate == 0.5 and got.opponent_map_matches == 2 and got.opponent_map_strength == 2.0
    assert got.team_rating_last_5 is None and got.team_map_matches == 0
    nobody = [(*asked[0][:5], None, *asked[0][6:])]
    got = inference_state(table(spark, nobody), table(spark, past)).first()
    assert got.opponent_rating_last_5 is None and got.opponent_map_matches == 0


def test_one_sided_requests_equal_two_sided(spark):
    rows = rows_of(7, 30)
    asked = [row(11, 999, "x", 40, 10, 20, "omen", None, None, None, None), row(12, 999, "x", 40, 10, 20, "jett", None, None, None, None), row(11, 1000, "z", 41, 10, 30, "omen", None, None, None, None)]
    other = [row(21, 999, "x", 40, 20, 10, "sage", None, None, None, None), row(31, 1000, "z", 41, 30, 10, "sage", None, None, None, None)]
    get = lambda a: {(r.player_id, r.match_id): r for r in inference_state(table(spark, a), table(spark, rows)).where("team_id = 10").collect()}
    one, two = get(asked), get(asked + other)
    # Role matchups order the rows of one time by player, and requests are rows.
    assert one.keys() == two.keys() and all(one[k].asDict() == two[k].asDict() for k in one)
    assert any(r.opponent_map_win_rate is not None for r in one.values())


def test_history_longer_than_its_cap(spark):
    rows = [row(1, i, "x", i / 100, rating=float(i % 7)) for i in range(620)]
    got = pit.barrier(table(spark, rows), ["player_id"], {"n": (features.F.count("rating"), pit.HISTORY), "m": (features.F.avg("rating"), pit.HISTORY)})
    r = got.where("match_id = 619").first()
    assert r.n == 500 and r.m == pytest.approx(mean(float(i % 7) for i in range(119, 619)))


def test_elo_is_sequential(spark):
    r = random.Random(3)
    maps, rating, want = [], {}, {}
    for m in range(80):
        pool = [1, 2, 3, 4] if m % 2 else [7, 8, 9]
        a, b = r.sample(pool, 2)
        maps.append((m, "x", datetime(2024, 1, 1) + timedelta(days=r.randint(0, 9)), a, b, r.choice([0.0, 0.5, 1.0, None])))
    for m, mp, _, a, b, res in sorted(maps, key=lambda x: (x[2], x[0])):
        x, y = rating.get(a, 1500.0), rating.get(b, 1500.0)
        want[m] = (x, y)
        if res is not None:
            move = 32 * (res - 1 / (1 + 10 ** ((y - x) / 400)))
            rating[a], rating[b] = x + move, y - move
    df = spark.createDataFrame([*maps, (900, "x", datetime(2024, 1, 1), None, 1, 1.0)], "match_id long, map string, ts timestamp, team_1_id long, team_2_id long, result double")
    got = {x.match_id: (x.elo_1, x.elo_2) for x in elo.rate_maps(df).collect()}
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)


def test_features_refuse_repeated_keys_and_missing_times(spark):
    one = row(1, 1, "x", 0)
    with pytest.raises(ValueError, match="more than one row"):
        features.build_features(table(spark, [one, one]))
    with pytest.raises(ValueError, match="without a timestamp"):
        features.build_features(table(spark, [one, (*row(1, 2, "x", 0)[:3], None, *row(1, 2, "x", 0)[4:])]))


@pytest.mark.parametrize("size", ["3", "10000"])
def test_means_don_t_depend_on_batches(spark, size):
    """A key over many batches and a timestamp across two of them."""
    rows = [row(p, i, "x", i // 4, rating=None if i % 5 == 0 else float(i * 7 % 11)) for p in (1, 2, None) for i in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {(r.player_id, r.match_id): r.e_ewm_3 for r in pit.ewm(table(spark, rows), "player_id", {"rating": "e"}, [3]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 60
    for (_, i), v in got.items():
        assert v == fold([r[12] for r in rows[:20] if r[1] // 4 < i // 4], 3) or v == pytest.approx(fold([r[12] for r in rows[:20] if r[1] // 4 < i // 4], 3))
