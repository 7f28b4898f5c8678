from datetime import date, datetime

import pytest
from pastframe.functions import cleaning as c
from pyspark.sql import functions as F


def one(spark, schema, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_numbers_and_percentages(spark):
    df = one(spark, "x string", "83%", " 4.5 ", "NaN", "Infinity", "", None, "a%")
    assert values(df, c.percent("x")) == [0.83, 0.045, None, None, None, None, None]
    assert values(df, c.percent("x", False))[0] == 83.0
    assert values(df, c.to_number("x")) == [None, 4.5, None, None, None, None, None]
    assert values(one(spark, "a double, b double", (6.0, 2.0), (1.0, 0.0)), c.ratio(F.col("a"), F.col("b"))) == [3.0, None]


def test_timestamps(spark):
    df = one(spark, "d string, t string", ("2024-01-02", "10:00 AM"), ("2024-01-02", "9:05 pm"), ("2024-01-02", "23:59:01"), ("2024-01-02", None), ("2024-01-02", "soon"), ("TBD", "10:00 AM"))
    got = values(df, c.match_timestamp("d", "t"))
    assert got == [datetime(2024, 1, 2, 10), datetime(2024, 1, 2, 21, 5), datetime(2024, 1, 2, 23, 59, 1), datetime(2024, 1, 2), datetime(2024, 1, 2), None]
    day = one(spark, "d string", "2024-01-01").select(c.match_timestamp("d").alias("t"))
    assert day.select(*[v.alias(k) for k, v in c.calendar("t").items()]).first() == (2024.0, 1.0, 0.0)


def test_roles(spark):
    df = one(spark, "agent string, role string", ("Jett", None), ("KAY/O", " "), ("new", None), (None, None), ("sage", "Flex"))
    got = [(r.role, r.role_confidence) for r in c.add_roles(df).collect()]
    assert got == [("Duelist", 0.98), ("Initiator", 0.98), ("Flex/Unknown", 0.0), ("Flex/Unknown", 0.0), ("Flex", 0.98)]
    assert values(df, c.simple_role("agent")) == ["Duelist", "Initiator", None, None, "Sentinel"]
    assert values(one(spark, "agent string", "veto"), c.simple_role("agent")) == ["Initiator"]


def test_stages_and_regions(spark):
    df = one(spark, "s string", "Group A", "Semifinal", "Grand Final", "Upper Final", "Showmatch", None, "Swiss")
    assert values(df, c.stage_importance("s")) == [0.4, 0.8, 1.0, 0.8, 0.5, 0.5, 0.4]
    df = one(spark, "t string", "EMEA League", "China vs EMEA", "South Asia Cup", "Masters", "Seaside", "SEA", None)
    assert values(df, c.semantic_region("t")) == ["EMEA", "CHINA", "PACIFIC", None, None, "PACIFIC", None]


def test_ids_of_urls(spark):
    df = one(spark, "u string", "https://x.y/event/12/name", "/event/7", "/eventful/7", "/team/3/abc", "https://x.y/4455/a-vs-b", None)
    assert values(df, c.id_from_url("u", "event")) == ["12", "7", None, None, None, None]
    assert values(df, c.id_from_url("u", "team")) == [None, None, None, "3", None, None]
    assert values(df, c.id_from_url("u", "match"))[4] == "4455"


def test_event_dates(spark):
    df = one(spark, "d string", "Jul 15 - Jul 20, 2024", "jul 15 – 20, 2024", "jul 15", None)
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in c.event_dates("d").items()]).collect()]
    assert got == [(date(2024, 7, 15), date(2024, 7, 20))] * 2 + [(None, None)] * 2


def test_winner_and_score(spark):
    df = one(spark, "a int, b int", (13, 9), (1, None), (5, 5), (None, None), (2, 3))
    assert values(df, c.winner([F.col("a")], [F.col("b")], F.lit("x"), F.lit("y"))) == ["x", "x", "Draw", "Draw", "y"]
    assert values(df, c.round_score([F.col("a"), F.col("a")], [F.col("b")])) == ["CT/T 26-9", "CT/T 2-0", "CT/T 10-5", "CT/T 0-0", "CT/T 4-3"]


def test_importance_of_stages_and_rounds(spark):
    """Groups win over playoffs, playoffs over finals."""
    rows = [("Group Stage Upper Final", None), ("group final", ""), ("Swiss", "semi"), ("Playoffs", "Grand Final"), ("Final", None), ("World", "Championship"), (None, "Lower"), (None, None), ("Show", "Regular")]
    df = one(spark, "s string, r string", *rows)
    assert values(df, c.stage_importance("s", "r")) == [0.4, 0.4, 0.4, 0.8, 1.0, 1.0, 0.8, 0.5, 0.4]


def test_texts_and_labels(spark):
    df = one(spark, "t string", " Alpha ", "TBD", "", None, "__unknown__")
    assert values(df, c.known_text("t")) == ["Alpha", None, None, None, None]
    assert values(one(spark, "t string", "  A \t b "), c.search_text("t")) == ["a b"]
    assert values(one(spark, "n int", 0, 1, 5, 6, 20, 21, None), c.experience_bucket("n")) == ["cold_start", "1-5", "1-5", "6-20", "6-20", "21+", None]
    assert values(one(spark, "n string, t string, k int", ("N", "T", 1)), c.display_label("n", "t", "k")) == ["N (T) · id=1"]
    out = one(spark, "c double, n double", (1.0, 9.0), (0.0, 4.0), (0.0, 5.0)).select(*[v.alias(k) for k, v in c.low_confidence("c", "n").items()])
    assert [r.low_confidence for r in out.collect()] == [True, True, False]
    filled = c.fill_unknown(one(spark, "map string", "x", None), ["map", "patch"]).collect()
    assert [(r.map, r.patch, r.match_importance) for r in filled] == [("x", "__unknown__", 0.5), ("__unknown__", "__unknown__", 0.5)]


@pytest.mark.parametrize("bad", ["rating2_all", "map_winner", "player_id"])
def test_leaks(bad):
    from pastframe.operators.splits import ensure_no_leakage

    ensure_no_leakage(["player_rating_last_5"], "acs_all")
    with pytest.raises(ValueError, match=bad):
        ensure_no_leakage(["player_rating_last_5", bad], "acs_all")
