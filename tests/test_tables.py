from datetime import datetime, timedelta

import pytest
from pastframe.functions import cleaning
from pastframe.operators import audit, dedup, fuzzy, joins, metrics, ml, profile, splits, views
from pastframe.sources import tables
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1)
APP = "player_id long, match_id long, map string, ts timestamp, team_id long, team string, opponent_team_id long, opponent_team string, agent string, role string, map_winner string, region string, rating double, acs double, kda double"


def app(spark):
    rows = []
    for m, (mp, day) in enumerate([("Ascent", 0), ("Bind", 1)], 1):
        for p, agent in ((1, "jett"), (2, "omen")):
            rows.append((p, m, mp, DAY + timedelta(days=day), 10, "Alpha", 20, "Bravo", agent if m == 1 or p == 2 else "raze", "Duelist", "Alpha", "EMEA", float(p), 200.0, 1.0))
    return spark.createDataFrame(rows, APP)


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 0)], "k int, v string, seq int")
    assert sorted(r.v for r in dedup.keep_last(df, ["k"], ["seq"]).collect()) == ["a", "c"]
    assert sorted(r.v for r in dedup.keep_first_source(df, ["k"], "v", ["seq"]).collect()) == ["a", "c"]
    assert sorted(r.v for r in dedup.latest_per(df, "k", ["seq"]).collect()) == ["a", "c"]
    assert dedup.keep_any(df, ["k"]).count() == 2


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="more than one row"):
        joins.many_to_one(left, spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"])
    assert joins.orphans(left, left.where("k = 1"), ["k"]).first().k == 2
    ask = spark.createDataFrame([(1, 5), (1, 3), (None, 9), (2, 1)], "k int, t int")
    have = spark.createDataFrame([(1, 3, "x", 0), (1, 4, "y", 1), (1, 4, "z", 2), (None, 1, "n", 3)], "k int, t int, v string, o int")
    got = {(r.k, r.t): r.v for r in joins.as_of(ask, have, "k", "t", ["v"], ["o"]).collect()}
    assert got == {(1, 5): "z", (1, 3): None, (None, 9): None, (2, 1): None}


def test_audits(spark):
    ev = spark.createDataFrame([("EMEA", 1, "Masters"), ("PACIFIC", 1, "masters "), ("EMEA", 2, "A"), ("PACIFIC", 2, "B")], "region string, event_id long, title string")
    shared = audit.shared_events(ev)
    assert [r.event_id for r in shared.collect()] == [1]
    m = spark.createDataFrame([("EMEA", 100, 1, "u"), ("PACIFIC", 100, 1, "u"), ("EMEA", 101, 2, "u"), ("PACIFIC", 101, 2, "u"), ("EMEA", 102, 1, "u")], "region string, match_id long, event_id long, match_url string")
    assert {r.match_id: r.expected for r in audit.classify_overlap(m, shared).collect()} == {100: True, 101: False}
    t = audit.title_report(spark.createDataFrame([("EMEA cup",), ("China cup",), ("x",)], "title string"), "EMEA").first()
    assert (t.explicit_region_matches, t.unclassified_titles, t.conflicting_titles, t.examples, t.valid) == (1, 1, 1, ["China cup"], False)
    kept, child = audit.prune_future(
        spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, "TBD"), (4, "2024-01-02")], "match_id long, match_date string"),
        {"maps": spark.createDataFrame([(1, 10), (2, 20)], "match_id long, team_id long")},
        "2024-01-02",
    )
    assert sorted(r.match_id for r in kept.collect()) == [1, 4] and [r.team_id for r in child["maps"].collect()] == [10]
    r = audit.gate(audit.key_report(spark.createDataFrame([(1, 1.0), (1, None)], "k int, y double"), ["k"], ["y"]), ["y"]).first()
    assert (r.rows, r.duplicate_keys, r.y_missing, r.complete_targets, r.passed) == (2, 1, 0.5, 1, False)


def test_completed_history(spark):
    df = app(spark)
    odd = df.limit(1).withColumns({"map": F.lit(None).cast("string")}).union(df.limit(1).withColumn("ts", F.lit(datetime(2099, 1, 1)))).union(df.limit(1).withColumn("kda", F.lit(None).cast("double")))
    ok = audit.completed(F.col("map"), F.col("map_winner"), [F.col(c) for c in ("rating", "acs", "kda")], F.col("ts"))
    assert df.union(odd).where(ok).count() == 4


def test_views(spark):
    df = app(spark)
    roster = {r.player_id: r for r in views.recent_roster(df).collect()}
    assert roster[1].recent_agents == "raze / jett" and roster[1].agent == "raze" and roster[1].maps_in_window == 2
    assert [r.map for r in views.map_keys(df).collect()] == ["Ascent", "Bind"] and views.map_history(df, ["map_winner"], ["player_id"]).count() == 2
    assert views.of_team(df, 10, "EMEA").count() == 4 and views.of_team(df, 10, "X").count() == 0
    assert views.opponents(df).first().opponent_team == "Bravo" and views.team_results(df).where("won").count() == 2
    trend = views.match_trend(df, ["team_id"], ["rating"], 1).collect()
    assert [(r.match_id, r.rating, r.place) for r in trend] == [(2, 1.5, 1)]
    with pytest.raises(ValueError):
        views.chart_rows(df, ["player_id"], ["rating", "acs", "kda"])
    with pytest.raises(ValueError):
        views.chart_rows(df, ["player_id"], ["nothing"])
    assert views.chart_rows(df, ["player_id"], ["rating"]).count() == 4


def test_requests(spark):
    df = app(spark)
    got = {(r.player_id, r.map): r for r in views.forecast_requests(df, 10, 30, [1, 2], "2024-02-01", ["x", "y"], {1: "sova"}).collect()}
    assert len(got) == 4 and got[(1, "x")].agent == "sova" and got[(2, "y")].agent == "__unknown__" and got[(2, "y")].opponent_team_id == 30
    with pytest.raises(ValueError, match="required"):
        views.forecast_requests(df, 10, None, [1], "2024-02-01", ["x"])
    with pytest.raises(ValueError, match="no completed history"):
        views.forecast_requests(df, 10, 30, [9], "2024-02-01", ["x"])
    asked = spark.createDataFrame([(1, 99, 98)], "player_id long, team_id long, opponent_team_id long")
    assert views.relevant_history(df, asked).count() == 2


def test_tags(spark):
    df = spark.createDataFrame([(1, 1, "", "p", "q"), (1, 2, "AA", "p", "q"), (1, 3, None, "p", "q"), (1, 4, "BB", "p", "q")], "g int, n int, tag string, i1 string, i2 string")
    assert [r.assigned_id for r in views.fill_tags(df, ["g"], "n", "tag", ["i1", "i2"]).orderBy("n").collect()] == ["p", "p", "p", "q"]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b\n\"c\""), (2, None)], "k int, v string")
    for kind in ("parquet", "csv", "json"):
        tables.write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(r.k for r in tables.read(spark, f"{tmp_path}/{kind}", kind, "k int, v string").collect()) == [1, 2]
    assert tables.read_preferred(spark, f"{tmp_path}/none", f"{tmp_path}/parquet").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_preferred(spark, f"{tmp_path}/none", f"{tmp_path}/nor")
    both = tables.merge_regions({"b": df, "a": df.drop("v")})
    assert sorted((r.region, r.v or "") for r in both.collect())[0] == ("a", "") and tables.only_columns(df, ["v", "z"]).columns == ["v"]
    assert [r.k for r in tables.not_loaded(df, df.where("k = 1"), "k").collect()] == [2]


def test_names(spark):
    names = spark.createDataFrame([("TenZ",), ("aspas",), ("Derke",), (None,), ("",)], "name string")
    got = [(r.query, r.name) for r in fuzzy.close_names(["tens", "aspaz", "qqqq", ""], names).collect()]
    assert sorted(got) == [("aspaz", "aspas"), ("tens", "TenZ")]


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "actual double, prediction double")


def test_calibration(spark):
    df = scored(spark, [(0.6, 0.8), (0.9, 0.95), (1.2, 1.1), (1.5, 1.25), (1.8, 1.4)])
    c = metrics.fit_calibration(df)
    assert c["enabled"] and c["slope"] > 1
    out = df.withColumn("new", metrics.apply_calibration("prediction", c)).agg(F.avg(F.abs(F.col("actual") - F.col("new"))), F.avg(F.abs(F.col("actual") - F.col("prediction")))).first()
    assert out[0] < out[1]
    assert metrics.fit_calibration(df.limit(2))["reason"] == "insufficient_validation_rows"
    assert metrics.fit_calibration(df.withColumn("prediction", F.lit(1.0)))["reason"] == "constant_raw_prediction"
    assert metrics.fit_calibration(df.withColumn("prediction", -F.col("prediction")))["reason"] == "non_positive_validation_slope"
    assert metrics.fit_calibration(df.withColumn("prediction", F.col("actual")))["reason"] == "validation_mae_not_improved"


def test_metrics(spark):
    r = metrics.metrics(scored(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 4.0), (None, 1.0), (4.0, float("nan"))])).first()
    assert (r.n, r.mae, r.r2) == (3, pytest.approx(2 / 3), pytest.approx(0.0)) and r.spearman == pytest.approx(0.8660254)
    one = metrics.metrics(scored(spark, [(1.0, 2.0)])).first()
    assert one.n == 1 and one.r2 is None and one.spearman is None
    by = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 5.0), (None, 1.0, 1.0)], "s string, actual double, prediction double")
    assert {x.s: x.n for x in metrics.sliced_metrics(by, "s").collect()} == {"a": 2, "__unknown__": 1}


def matches(spark, n):
    return spark.createDataFrame([(m, p, DAY + timedelta(days=m // 2)) for m in range(n) for p in (1, 2)], "match_id long, player_id long, ts timestamp")


def test_splits(spark):
    got = splits.chronological_split(matches(spark, 10)).collect()
    parts = {s: {r.match_id for r in got if r.split == s} for s in ("train", "validation", "test")}
    assert len(got) == 20 and parts == {"train": set(range(7)), "validation": {7}, "test": {8, 9}}
    w = [(a.collect(), b.collect()) for a, b in splits.rolling_splits(matches(spark, 20))]
    assert len(w) == 3
    for a, b in w:
        assert max(r.match_id for r in a) < min(r.match_id for r in b) and max(r.match_id for r in b) < 17
    periods = [r.time_period for r in splits.time_periods(matches(spark, 5), ["ts", "match_id", "player_id"]).orderBy("ts", "match_id", "player_id").collect()]
    assert periods == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_splits_of_few_matches_and_bad_rows(spark):
    assert splits.window_starts(2) == [(1, 2)] and splits.bounds(2) == (1, 2) and splits.bounds(3) == (2, 3)
    lost = matches(spark, 4).unionByName(spark.createDataFrame([(9, 1, None)], "match_id long, player_id long, ts timestamp"))
    for f in (splits.chronological_split, splits.rolling_splits):
        with pytest.raises(ValueError, match="without"):
            f(lost)
    with pytest.raises(ValueError):
        splits.bounds(10, 0.9, 0.2)
    with pytest.raises(ValueError):
        splits.window_starts(10, first=0.9)


def test_gate_warns_of_missing_targets(spark):
    from pastframe.operators import audit

    check = lambda *rows: audit.gate(audit.key_report(spark.createDataFrame(list(rows), "k int, a double, b double"), ["k"], ["a", "b"]), ["a", "b"]).first()
    assert (check((1, None, 1.0), (2, 1.0, 1.0)).passed, check((1, None, 1.0), (2, 1.0, 1.0)).warnings) == (True, 1)
    assert not check((1, None, 1.0), (2, 1.0, None)).passed and not check((1, 1.0, 1.0), (1, 1.0, 1.0)).passed


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 4.0), ("b", None, None)], "c string, x double, y double")
    assert {r.column: r.missing for r in profile.null_counts(df).collect()} == {"c": 0, "x": 1, "y": 2}
    assert {r.pattern: r.rows for r in profile.null_patterns(df).collect()} == {"y": 1, "x | y": 1}
    assert {(r.missing_columns, r.rows) for r in profile.nulls_per_row(df).collect()} == {(0, 1), (1, 1), (2, 1)}
    assert profile.histogram(df, "x", 2).count() == 2 and profile.histogram(df.where("x > 9"), "x").count() == 0
    filled = profile.fill_by_role(df.withColumn("role", F.col("c")), ["x"]).collect()
    assert sorted(r.x for r in filled) == [1.0, 1.5, 2.0]


def test_models_score_sparse_and_unseen_rows(spark, tmp_path):
    rows = [(float(i % 9), "m" + str(i % 3), float(i % 9) * 2 + (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "player_rating_last_5 double, map string, y double")
    model = ml.fit(df, "ridge", "y", ["player_rating_last_5"], ["map", "agent"], regParam=0.0)
    assert ml.evaluate(model, df).first().r2 > 0.99
    odd = spark.createDataFrame([("new", 1), (None, 2)], "map string, k int")
    assert model.predict(odd).where("prediction is not null").count() == 2
    model.save(f"{tmp_path}/m")
    again = ml.load(f"{tmp_path}/m", model.metadata())
    assert again.predict(odd).select("prediction").collect() == model.predict(odd).select("prediction").collect()
    with pytest.raises(ValueError, match="leaky"):
        ml.fit(df.withColumnRenamed("map", "map_winner"), "ridge", "y", ["player_rating_last_5"], ["map_winner"])


def test_roles_of_new_rows(spark):
    assert cleaning.add_roles(spark.createDataFrame([(1,)], "k int")).first().role == "Flex/Unknown"


def test_null_category_is_the_most_frequent(spark):
    df = spark.createDataFrame([(float(x), m, y) for x, m, y in [(1, "a", 5.0), (2, "a", 5.0), (3, "a", 5.0), (4, "b", 1.0), (5, "b", 1.0)]], "x double, map string, y double")
    model = ml.fit(df, "ridge", "y", ["x"], ["map"], regParam=0.0)
    got = {r.map: r.prediction for r in model.predict(spark.createDataFrame([(2.0, "a"), (2.0, None), (2.0, "new")], "x double, map string")).collect()}
    assert got[None] == pytest.approx(got["a"]) and got["new"] != pytest.approx(got["a"])


def test_saved_models_are_evaluated_on_the_test_part(spark, tmp_path):
    rows = [(i, i % 5, datetime(2024, 1, 1 + i), float(i), 2.0 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "match_id long, player_id long, ts timestamp, x double, y double").withColumn("map", ml.F.lit("m"))
    ml.fit(df, "ridge", "y", ["x"], ["map"], regParam=0.0).save(f"{tmp_path}/m")
    (r,) = ml.reevaluate(df, {"line": f"{tmp_path}/m"}).collect()
    assert (r.model, r.target, r.split, r.n) == ("line", "y", "test", 3) and r.mae < 1e-6


def test_baseline_lines_fill_with_train_medians(spark):
    train = spark.createDataFrame([(1.0, 10.0, 8.0, 0.0), (3.0, 20.0, 9.0, 10.0), (5.0, None, 7.0, 20.0)], "y double, team_rating_last_5 double, opponent_rating_last_5 double, elo_gap double")
    out = ml.baseline_lines(train, spark.createDataFrame([(None, None, None, 5.0), (None, None, None, None)], train.schema), "y").collect()
    assert [r.elo_only for r in out] == [pytest.approx(2.0), pytest.approx(3.0)] and all(r.team_opponent_historical is not None for r in out)


def test_slices_of_scored_rows(spark):
    day = lambda i: datetime(2024, 1, 1 + i)
    rows = [(1, i, "m", day(i), n, n, o, k, c, 1.0 * i, 2.0) for i, (n, o, k, c) in enumerate([(0, None, 0, None), (5, 1.0, 1, 0.8), (20, 1.0, 2, 0.79), (21, None, 3, 1.0)])]
    df = spark.createDataFrame(rows, "player_id long, match_id long, map string, ts timestamp, player_matches_played long, player_role_matches_played long, opponent_rating_last_5 double, player_map_matches_played long, lineup_continuity double, actual double, prediction double")
    got = {(r.slice, r.value): (r.n, r.mae) for r in metrics.slice_report(metrics.slice_columns(df)).collect()}
    assert got[("experience_bucket", "cold_start")] == (1, 2.0) and got[("role_experience", "21+")] == (1, 1.0)
    assert got[("known_opponent", "known")] == (2, 0.5) and got[("known_map", "unknown")] == (1, 2.0)
    assert got[("roster_stability", "stable")] == (2, 1.0) and got[("map", "m")] == (4, 1.0)
    assert {v for s, v in got if s == "time_period"} == {"0", "1", "2"} or {v for s, v in got if s == "time_period"} == {"0", "1", "2", "3"}


def test_deletion_cost(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "c string, x double")
    assert {r.column: (r.missing, r.rows_deleted, r.rows_retained) for r in profile.deletion_cost(df).collect()} == {"c": (0, 0, 2), "x": (1, 1, 1)}


def test_dataset_from_raw_tables(spark):
    from pastframe.operators.dataset import build_dataset

    p = spark.createDataFrame(
        [(1, "ann", "7", "70", "jett", "ascent", "1", "1.2", "200", "10", "5", "3", "75%"), (2, "ann", "7", "70", "jett", "ascent", "1", "1.5", "210", "12", "5", "3", "80%"),
         (3, "bob", "8", "80", "sage", "ascent", "1", "0.9", "150", "8", "0", "3", "60%"), (4, "cat", "9", "70", "omen", "bind", "2", None, "150", "8", "1", "3", "60%"),
         (5, "ann", "7", "70", "jett", "bind", "2", "1.0", "150", "8", "4", "4", "x"), (6, "dan", "6", None, "jett", "bind", "2", "1.0", "150", "8", "4", "4", "x"),
         (7, "ann", "7", None, "jett", "ascent", "1", "9.9", "999", "12", "5", "3", "80%"), (8, "bob", "8", "", "sage", "ascent", "1", "9.9", "999", "8", "0", "3", "60%")],  # later, but of no team
        "n int, name string, player_id string, team_id string, agent string, map string, match_id string, rating2_all string, acs_all string, kills_all string, deaths_all string, assists_all string, kast_all string",
    )
    m = spark.createDataFrame([(1, "2024-05-01", "Group Stage", "Final", None), (1, "2024-05-02", "Group Stage", "Final", None), (2, "2024-05-03", "Playoffs", "", "0.9")], "match_id long, match_date string, stage string, round string, match_importance string")
    t = spark.createDataFrame([("1", "ascent", 70, 80, "A", "B", "A"), ("1", "ascent", 70, 80, "A", "B", "B"), ("2", "bind", 80, 70, "B", "A", "draw")], "match_id string, map_name string, team_1_id int, team_2_id int, team_1 string, team_2 string, map_winner string")
    out = build_dataset(p, m, t, {"players": ["n"], "matches": ["match_date"], "maps": ["map_winner"]})
    got = {(r.player_id, r.match_id): r for r in out.collect()}
    assert set(got) == {(7, 1), (8, 1), (7, 2)}
    a, b, c = got[(7, 1)], got[(8, 1)], got[(7, 2)]
    assert (a.rating2_all, a.kda_all, a.kast_all, a.player_name, a.role) == (1.5, 3.0, pytest.approx(0.8), "ann", "Duelist") and b.kda_all is None
    assert (a.opponent_team_id, a.opponent_team, b.opponent_team_id, c.opponent_team_id) == (80, "B", 70, 80)
    assert (a.match_importance, c.match_importance, str(a.match_date), a.map_winner) == (0.4, 0.9, "2024-05-02", "B")
    assert (a.team_elo, a.opponent_elo, b.elo_gap) == (1500.0, 1500.0, 0.0) and (c.team_elo, c.opponent_elo, c.elo_gap) == (1484.0, 1516.0, -32.0)


def test_gate_findings(spark):
    from pastframe.operators import audit

    m = spark.createDataFrame([("A", 1, "u", 1, "2024-01-01"), (None, 1, "u", 1, "soon")], "region string, match_id long, match_url string, event_id long, match_date string")
    p = spark.createDataFrame([("A", 1, 1, "jett", "x", 1, 1.0, None, 1, 1), ("A", 1, 1, "jett", "x", 9, None, 1.0, 1, 1)], "region string, player_id long, team_id long, agent string, map string, match_id long, rating2_all double, acs_all double, kills_all int, deaths_all int")
    t = spark.createDataFrame([(None, 1, "x")], "region string, match_id long, map_name string")
    found = audit.gate_findings({"matches": m, "players_stat": p, "match_maps_stat": t})
    assert {(r.table, r.finding, r.level): r.n for r in found.collect()} == {
        ("matches", "missing_region", "error"): 1, ("matches", "duplicate_keys", "error"): 1, ("matches", "unreadable_dates", "warning"): 1,
        ("players_stat", "missing_rating2_all", "warning"): 1, ("players_stat", "missing_acs_all", "warning"): 1, ("players_stat", "no_complete_targets", "error"): 1, ("players_stat", "orphan_rows", "error"): 1,
        ("match_maps_stat", "missing_columns", "error"): 4, ("match_maps_stat", "missing_region", "error"): 1, ("match_maps_stat", "no_region", "error"): 1,
    }
    assert tuple(audit.gate_status(found).first()) == ("failed", 7, 3)
    assert tuple(audit.gate_status(found.where("level = 'warning'")).first()) == ("passed", 0, 3)


def test_bucketed_dataset_without_shuffle(spark, tmp_path):
    """Three raw tables staged by match: dedup and both joins read them in place, with the rows of the plain job."""
    from pastframe.operators import dataset

    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    p = own.range(3000).selectExpr(
        "id AS n", "concat('p', id % 40) AS name", "cast(id % 40 AS string) AS player_id", "cast(id % 2 AS string) AS team_id", "'jett' AS agent", "concat('m', id % 3) AS map",
        "CASE WHEN id % 50 = 7 THEN 'x' WHEN id % 3 = 0 THEN '1' ELSE cast(id % 100 AS string) END AS match_id", "'1.5' AS rating2_all", "cast(id AS string) AS acs_all", "'3' AS kills_all", "'2' AS deaths_all", "'1' AS assists_all",
    )
    m = own.range(100).selectExpr("id AS match_id", "'2024-05-01' AS match_date", "'Playoffs' AS stage", "'Final' AS round")
    t = own.range(300).selectExpr("id % 100 AS match_id", "concat('m', id % 3) AS map_name", "0L AS team_1_id", "1L AS team_2_id", "'A' AS team_1", "'B' AS team_2", "'A' AS map_winner")
    orders = {"players": ["n"], "matches": ["match_date"], "maps": ["map_winner"]}
    staged = [dataset.stage_by_match(df, f"staged_{k}", str(tmp_path / k), 8) for df, k in zip((p, m, t), orders, strict=True)]
    got = dataset.build_dataset(*staged, orders, elo=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = dataset.build_dataset(p, m, t, orders, elo=False)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 400
    for k in orders:
        own.sql(f"DROP TABLE staged_{k}")
