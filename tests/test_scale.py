"""What lets jobs grow: rows move and are read no more often than they must, and the results stay."""

import json
import random
from datetime import datetime

import pandas as pd
import pytest
from pastframe.operators import dedup, features, graph, metrics, ml, pit, rerun, search, splits
from pastframe.plans import fact
from pastframe.streaming import history, loading
from pyspark.sql import functions as F
from test_history import rows_of, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Fake:
    """A state handle that counts calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, *_):
        return FakeState(self, [])

    def getMapState(self, *_):
        return FakeState(self, {})

    def getValueState(self, *_):
        return FakeState(self, None)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class FakeState:
    def __init__(self, handle, x):
        self.handle, self.x, self.empty = handle, x, x

    def __getattribute__(self, name):
        get = object.__getattribute__
        if not name.startswith("_") and name not in ("handle", "x", "empty"):
            get(self, "handle").calls += 1
        return get(self, name)

    def appendList(self, new):
        self.x = [*self.x, *new]

    def put(self, new):
        assert new
        self.x = list(new)

    def clear(self):
        self.x = []

    def get(self):
        return self.x

    def exists(self):
        return self.x is not None

    def update(self, x):
        self.x = x

    def containsKey(self, k):
        return k in self.x

    def getValue(self, k):
        return self.x[k]

    def updateValue(self, k, v):
        self.x[k] = v

    def removeKey(self, k):
        del self.x[k]

    def keys(self):
        return list(self.x)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


@pytest.mark.parametrize("many", [1_000, 7])
def test_state_is_called_by_key_and_not_by_slot(many):
    """Before, each of a key's slots had a timer and some ten calls. With few rows held, slots lie in a map and give the same."""
    r, hour = random.Random(1), 3_600_000
    rows = [(r.randint(0, 50 * hour) * 1000, float(r.randint(0, 9)), json.dumps({"id": i})) for i in range(200)]
    handle = Fake()
    p = history._History(["id"], hour, 0.5, None, many)
    p.init(handle)
    for part in (rows[:120], rows[120:]):
        p.handleInputRows(None, iter([pd.DataFrame(part, columns=history.OUT[:3])]), At(0))
    assert handle.calls <= 4
    out = [*p.handleExpiredTimer(None, At(30 * hour), At(min(handle.timers)))]
    first = sum(map(len, out))
    out += [*p.handleExpiredTimer(None, At(60 * hour), At(60 * hour))]
    assert handle.calls <= 20 or many == 7
    got = pd.concat(out)
    want = sorted(rows, key=lambda x: (x[0], json.loads(x[2])["id"]))
    assert first == sum(x[0] < 30 * hour * 1000 for x in rows)
    assert got.carried__.tolist() == [x[2] for x in want]
    assert got.n_before.tolist() == [sum(y[0] < x[0] for y in rows) for x in want]


def test_a_batch_adds_one_file_to_a_bucket(spark, tmp_path):
    """Before, every task of a batch added one to each bucket."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "4")
    target = loading.Target(str(tmp_path / "t"), ("id",), buckets=3)
    for k in range(2):
        loading.add_batch(own.range(k * 300, k * 300 + 400).withColumn("value", F.lit("x")), k, target)
    assert {len([*p.glob("*.parquet")]) for p in (tmp_path / "t" / "rows").glob("load_bucket=*")} == {2}
    assert sorted(r.id for r in target.table(own).collect()) == list(range(700))


def test_recent_matches_copy_no_row(spark):
    """Before, every row became up to seven events that carried all of its columns."""
    df = table(spark, rows_of(3, 20))
    got = pit.distinct_in_days(df, ["player_id"], "match_id", [7, 14, 30], "n_")
    assert "Generate" not in plan(got)
    assert "match_importance" not in got.columns and got.count() == df.count()


def test_checkpoints_are_columns(spark):
    df = graph.checkpointed(spark.range(1000).select("id", F.lit("a long text that repeats").alias("t"), F.array(F.lit(None).cast("double")).alias("a")))
    assert "Scan parquet" in plan(df) and df.where("t like 'a long%' and a[0] is null").count() == 1000
    assert graph.checkpointed(spark.range(2).withColumn("v", F.lit(None))).count() == 2  # no type: a checkpoint as before


def tables(spark, folder):
    r, day = random.Random(5), datetime(1995, 1, 1)
    lines = [(r.choice([1, 2, 3, 4, None]), r.randint(1, 4), r.choice([1, 2, None]), r.choice([1, 2, 3, 4, 5, 6, None]), float(r.randint(1, 50)), 100.0 + i, r.choice([0.0, 0.05]), 0.02, "A", "F", day) for i in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 1, day, "x"), (2, 2, day, "y"), (2, 1, day, "z"), (3, 9, None, "x"), (4, None, day, "y")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 5), (2, 6)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(1, "SMALL"), (2, "LARGE"), (2, None)], "p_partkey long, p_type string").write.parquet(f"{folder}/part.parquet")


def test_fact_moves_line_items_twice(spark, tmp_path):
    """To their part and to their order, where they moved six times; repeated and missing keys multiply and drop rows as joins do."""
    tables(spark, str(tmp_path))
    got = fact.fact(spark, str(tmp_path))
    moves = plan(got).count("Exchange hashpartitioning(l_partkey") + plan(got).count("Exchange hashpartitioning(l_orderkey") + plan(got).count("Exchange hashpartitioning(l_suppkey")
    assert moves <= 4  # of lines and of the parts and orders that they meet
    lines = fact.table(spark, str(tmp_path), "lineitem").collect()
    last = {}
    for x in lines:
        m = None if x.l_linenumber is None else f"map{x.l_linenumber % 3}"
        if x.l_orderkey is not None:
            k = (x.l_suppkey, x.l_orderkey, m)
            order = lambda x: ((x.l_linenumber is not None, x.l_linenumber or 0), x.l_partkey, x.l_extendedprice)
            if k not in last or order(x) > order(last[k]):
                last[k] = x
    times = lambda x: {1: 1, 2: 2 * 1 + 1, 4: 1}.get(x.l_orderkey, 0) * (2 if x.l_partkey == 2 else 1)
    assert got.count() == sum(times(x) for x in last.values())
    key = lambda r: (r.player_id if r.player_id is not None else -1, r.match_id, r.map or "")
    want = sorted(key for (p, o, m), x in last.items() for key in [(p if p is not None else -1, o, m or "")] * times(x))
    assert sorted(map(key, got.collect())) == want


def test_keep_last_where_rows_lie(spark):
    rows = [(m, p, i) for i, (m, p) in enumerate((m, p) for m in (1, 2, None) for p in ("a", None, "a", "b", None))]
    df = spark.createDataFrame(rows, "m int, p string, i int")
    got = dedup.keep_last(df, ["m", "p"], ["i"], ["m"])
    assert "hashpartitioning(m#" in plan(got) and plan(got).count("Exchange") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, dedup.keep_last(df, ["m", "p"], ["i"]).collect()))


def test_ranks_are_of_distinct_pairs(spark, monkeypatch):
    """Before, every row was joined to its ranks."""
    seen, ranks = [], metrics.average_ranks
    monkeypatch.setattr(metrics, "average_ranks", lambda df, *a: seen.append(df.count()) or ranks(df, *a))
    r = random.Random(6)
    rows = [(float(r.randint(0, 3)), float(r.randint(0, 4)), r.choice("ab")) for _ in range(500)]
    df = spark.createDataFrame(rows, "y double, p double, s string")
    got = {x.s: x.spearman for x in metrics.sliced_metrics(df, "s", "y", "p").collect()}
    want = {}
    for s in "ab":
        y, p = (pd.Series([x[i] for x in rows if x[2] == s]).rank() for i in (0, 1))
        want[s] = y.corr(p)
    assert got == pytest.approx(want)
    assert max(seen) <= 40
    assert metrics.metrics(df, "y", "p", ["mae"]).columns == ["mae"] and len(seen) == 2


def models(spark):
    r = random.Random(7)
    rows = [(i, float(r.randint(0, 9)) if r.random() < 0.9 else None, r.choice(["u", "v", None]), float(i % 7)) for i in range(300)]
    return spark.createDataFrame(rows, "match_id int, x double, c string, y double")


def test_rows_are_made_into_vectors_once(spark, monkeypatch):
    """The same models as from ``fit``, whose preprocessing ran again for every candidate and trial."""
    df, calls, pre = models(spark), [], ml.preprocessor
    plain = ml.fit(df, "ridge", "y", ["x"], ["c"]).pipeline.stages[-1].coefficients
    assert ml.vectors(df, "y", ["x"], ["c"]).fit("ridge").pipeline.stages[-1].coefficients.toArray() == pytest.approx(plain.toArray())
    monkeypatch.setattr(ml, "preprocessor", lambda *a: calls.append(1) or pre(*a))
    windows = [(df.where("match_id < 200"), df.where("match_id >= 200"))]
    assert ml.rolling_candidates(windows, ["ridge", "huber"], "y", ["x"], ["c"]).count() == 3
    assert len(calls) == 1
    calls.clear()
    spec = search.RANGES | {"maxIter": ("int", 2, 4, 1), "maxDepth": ("int", 2, 2, 1)}
    found = search.search_trees(*windows[0], "y", ["x"], ["c"], trials=3, spec=spec)
    assert len(calls) == len({share for _, share, _ in found}) == 3


def test_rolling_windows_are_not_joined_again(spark):
    windows = splits.rolling_splits(table(spark, rows_of(8, 30)))
    assert all("Join" not in plan(x) for w in windows for x in w)


def test_fresh_rows_are_computed_once(spark, tmp_path, monkeypatch):
    """Before, keys, partitions and content each computed all features again."""
    df = table(spark, rows_of(9, 10)).withColumn("part", F.date_format("ts", "yyyy-MM-dd"))
    df.write.partitionBy("part").parquet(str(tmp_path / "t"))
    ran = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            ran.add(p.num_rows)
            yield p

    fresh = df.where("player_id % 2 = 0").mapInArrow(count, df.schema)
    rerun.replace_rows(str(tmp_path / "t"), fresh, df.limit(0), "part")
    assert ran.value == df.where("player_id % 2 = 0").count()
    assert spark.read.parquet(str(tmp_path / "t")).count() == df.count()


def test_python_sees_narrow_rows_once(spark):
    """Before, exponential means were made again for teams, rosters and pairs of roles, behind all columns."""
    df = table(spark, rows_of(10, 10))
    got = features.build_features(df)
    assert plan(got).count("MapInArrow") == 1 and set(features.EWM) <= set(got.columns)
