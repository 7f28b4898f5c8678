"""Exact quantiles, distinct rows, correlations and sliding counts against plain computations."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pastframe.operators import audit, distinct, pit, profile, quantiles
from pyspark.sql import functions as F


@pytest.mark.parametrize("accuracy", [10_000, 60])  # coarse sketches make wide brackets
def test_quantiles_equal_numpy(spark, accuracy):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(0, 9)), r.gauss(0, 1e6)]), 1.5) for _ in range(900)] + [("one", 7.0, None), ("none", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(q.g, q.column): q for q in quantiles.exact_quantiles(df, ["g"], ["x", "y"], probs, accuracy).collect()}
    assert len(got) == 10
    for (g, c), q in got.items():
        x = [row[1 if c == "x" else 2] for row in rows if row[0] == g]
        x = [v for v in x if v is not None]
        assert q["count"] == len(x)
        for i, p in enumerate(probs):
            assert (q[f"q{i}"] is None) if not x else q[f"q{i}"] == pytest.approx(np.quantile(x, p))
    whole = quantiles.exact_quantiles(df, [], ["x"], [0.5], accuracy).first()
    assert whole.q0 == pytest.approx(np.median([v for _, v, _ in rows if v is not None]))
    assert quantiles.exact_quantiles(df.limit(0), ["g"], ["x"], probs).count() == 0
    assert quantiles.medians(df.limit(0), [], "x").first().median is None


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i % 7, None if i % 3 else "s", {"k": i % 2}) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, m map<string,int>")
    want = len({(a, b, m["k"]) for a, b, m in rows})
    for mark in (None, F.lit(1), F.col("a") % 2):
        got = distinct.distinct_rows(df, fingerprint=mark).first()
        assert (got.rows, got.distinct) == (60, want)
    assert tuple(distinct.distinct_rows(df.limit(0)).first()) == (0, 0)
    report = audit.key_report(df, ["a", "b"], ["b"]).first()
    assert (report.rows, report.duplicate_rows, report.duplicate_keys, report.null_keys) == (60, 60 - want, 60 - len({r[:2] for r in rows}), 40)


def test_correlations_are_pairwise_complete(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 9)) * 10.0 ** np.arange(9) + 1e6
    x[:, 3] = x[:, 2] * -2 + g.normal(size=400) * 50
    x[g.random(x.shape) < 0.2] = np.nan
    x[:, 8] = 5.0
    names = [f"f{i}" for i in range(9)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    got = {(r.a, r.b): r.r for r in profile.correlations(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names).collect()}
    want = pd.DataFrame(x, columns=names).corr()
    assert len(got) == 81
    for (a, b), r in got.items():
        w = want.loc[a, b] if "f8" not in (a, b) else None
        assert (r is None) if w is None else r == pytest.approx(w, abs=1e-9), (a, b)


def test_sliding_counts(spark):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(12)]), start + timedelta(days=r.choice([r.randint(0, 60), r.random() * 60]))) for _ in range(300)]
    rows += [(9, m % 50, start + timedelta(minutes=m)) for m in range(3_000)]  # many rows within the days
    got = pit.distinct_in_days(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, p int, m int, ts timestamp"), ["p"], "m", [7, 30], "n_")
    assert got.columns == ["i", "p", "m", "ts", "n_7d", "n_30d"]
    got = {x.i: (x.n_7d, x.n_30d) for x in got.collect()}
    assert len(got) == len(rows)
    for i, (p, _, t) in enumerate(rows):
        if p != 9 or i % 97 == 0:
            near = [(m, u) for q, m, u in rows if q == p and m is not None and u < t]
            assert got[i] == tuple(float(len({m for m, u in near if u >= t - timedelta(days=d)})) for d in (7, 30)), i
    assert got[len(rows) - 1] == (50.0, 50.0)


def test_ten_examples(spark):
    rows = [(f"Champions China {i:02}",) for i in range(30)] + [("Masters EMEA",), ("anything",)]
    report = audit.title_report(spark.createDataFrame(rows, "title string"), "emea").first()
    assert report.rows == 32 and report.conflicting_titles + report.explicit_region_matches + report.unclassified_titles == 32
    assert report.examples == sorted(report.examples) and len(report.examples) == min(10, report.conflicting_titles)
