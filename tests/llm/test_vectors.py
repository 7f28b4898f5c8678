import heapq

import numpy as np
import pytest
from pastframe.llm import vector_codes, vector_search
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, _label string, rank int, ids string"


def rows(x, labels=None, start=0):
    return [(start + i, [float(v) for v in row], None if labels is None else labels[i], "x", 0, "x") for i, row in enumerate(x)]


def plain_codes(vectors, entries=256, rounds=4):
    """Codes, errors and codebooks by comparing everything with everything in whole numbers."""
    x = [[int(np.floor(1024 * np.float64(np.float32(v)))) for v in row] for row in vectors]
    cut = len(x[0]) // 4
    part = lambda row, p: row[p * cut : (p + 1) * cut]
    apart = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    books = [[part(row, p) for row in x[:entries]] for p in range(4)]
    near = lambda row, p: min((apart(part(row, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            of = {}
            for row in x:
                of.setdefault(near(row, p)[1], []).append(part(row, p))
            books[p] = [[sum(c) // len(of[i]) for c in zip(*of[i], strict=True)] if i in of else e for i, e in enumerate(books[p])]
    found = [[near(row, p) for p in range(4)] for row in x]
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("scale", [1, 60_000])
def test_codes_equal_brute_force(spark, scale):
    r = np.random.default_rng(0)
    x = np.float32(r.normal(0, 0.3, (400, 8)) * scale)
    x = np.clip(x, -60_000, 60_000)
    x[10:40] = x[5]  # copies, and with them equal entries
    x[300:] = np.round(x[300:] / scale, 1) * scale  # ties
    labels = [None if i % 7 == 0 else i % 3 for i in range(400)]
    codes, errors, books = plain_codes(x)
    got, found = vector_codes.compress(spark.createDataFrame(rows(x, labels), SCHEMA))
    got = {row.id: row for row in got.collect()}
    assert [got[i].code for i in range(400)] == codes and [got[i].error for i in range(400)] == errors
    assert [b.tolist() for b in found] == books
    for lab in (None, 0, 1, 2):
        total = sum(e for e, of in zip(errors, labels, strict=True) if of == lab)
        assert {got[i].label_error for i in range(400) if labels[i] == lab} == {total}


def test_gnat_equals_comparison_and_skips():
    r = np.random.default_rng(1)
    centres = r.integers(-50_000, 50_000, (16, 6))
    entries = np.concatenate([centres[r.integers(0, 16, 200)] + r.integers(-40, 40, (200, 6)), np.repeat(centres[:2], 28, 0)])
    q = np.concatenate([entries[::3], centres[r.integers(0, 16, 500)] + r.integers(-60, 60, (500, 6)), r.integers(-90_000, 90_000, (200, 6))])
    d = vector_codes.squared(q, entries)
    assert (d == ((q[:, None, :] - entries[None]) ** 2).sum(2)).all()
    seen, plain = [0], vector_codes.squared
    try:
        vector_codes.squared = lambda a, b: (seen.__setitem__(0, seen[0] + len(a) * len(b)), plain(a, b))[1]
        tree = vector_codes.Gnat(entries)
        seen[0] = 0
        at, least = tree.nearest(q)
    finally:
        vector_codes.squared = plain
    assert (at == d.argmin(1)).all() and (least == d.min(1)).all()
    assert seen[0] < d.size / 2


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(90, None, 1), (91, [0.1, None, 0.2, 0.3], 1), (92, [nan, 0.0, 0.0, 0.0], 1), (93, [inf, 0.0, 0.0, 0.0], 1), (94, [], 1), (95, [1.0] * 8, 1)]
    good = [(1, [0.5, -0.5, 0.0, 0.001], None), (2, [0.0] * 4, 1), (2, [0.0] * 4, 1), (None, [9.0, 9.0, 9.0, 9.0], 1)]
    df = spark.createDataFrame([(*r, "x", 0, "x") for r in [*odd, *good]], SCHEMA)
    got, books = vector_codes.compress(df)
    got = got.collect()
    assert sorted(str(r.id) for r in got) == ["1", "2", "2", "None"] and all(len(b) == 4 for b in books)
    assert {r.code for r in got if r.id == 2} == {"01010001"}  # ties to the lower of equal entries
    empty, none = vector_codes.compress(df.limit(0))
    assert empty.count() == 0 and none == []
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame(rows([[1, 2, 3]]), SCHEMA))


def clustered(n, dim=16):
    r = np.random.default_rng(2)
    return np.float32(r.normal(size=(12, dim))[r.integers(0, 12, n)] + r.normal(0, 0.4, (n, dim)))


def plain_nearest(ids, x, asks, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    out = set()
    for i in asks:
        s = u @ u[i]
        out |= {(ids[i], ids[j]) for j in heapq.nsmallest(k, (j for j in range(len(x)) if ids[j] != ids[i]), key=lambda j: (-round(s[j], 12), ids[j]))}
    return out


def test_recall_and_exact_scores(spark):
    x = clustered(3_000)
    x[100:140] = x[3]  # more copies than neighbours
    x[200:230] = 8 * x[50]  # equal cosines of different vectors
    got = vector_search.nearest(spark.createDataFrame(rows(x), SCHEMA), F.col("vec_id") % 50 == 0).collect()
    ids, asks = list(range(len(x))), range(0, len(x), 50)
    true = plain_nearest(ids, x, asks, 5)
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
        a, b = x[r.query_id].astype(float), x[r.vec_id].astype(float)
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12) and r.vec_id != r.query_id
    assert set(by) == set(asks)
    assert all([r.rank for r in of] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in of] == sorted((-r.score, r.vec_id) for r in of) for of in by.values())
    assert [r.vec_id for r in by[100]] == [3, 101, 102, 103, 104] and [r.vec_id for r in by[50]] == [200, 201, 202, 203, 204]


def test_structure_needs_few_visits(spark):
    x = clustered(4_000)
    df = spark.createDataFrame(rows(x), SCHEMA).select(F.col("embedding").cast("array<double>").alias("vector"), F.array(F.col("vec_id")).alias("ids"))
    index, placed = vector_search.build_index(df, 16)
    asks = df.where("ids[0] % 50 = 0").select(F.col("ids")[0].alias("id"), "vector")
    assert index.rows.sum() == 4_000 and vector_search.needed_share(index, placed, asks, 16, 5) < 0.2


def test_traversal_is_by_summed_distance():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = r.random(7).round(1), r.random(5).round(1)
        n = r.integers(0, 4, (7, 5))
        for least in (1, 5, int(n.sum())):
            got = vector_search.traverse(a, b, n, least)
            seen = {(c, j) for c, m in got for j in np.argsort(b, kind="stable")[:m]}
            d = a[:, None] + b[None, :]
            order = np.sort(np.unique(d))
            far = next(x for x in order if n[d <= x].sum() >= least)
            want = {tuple(t) for t in np.argwhere(d <= far)}
            assert {t for t in seen if n[t]} == {t for t in want if n[t]}


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [0.0] * 4), (102, [nan, 1.0, 1.0, 1.0]), (150, [inf, 0.0, 0.0, 1.0]), (151, [None, 1.0, 0.0, 0.0]), (152, []), (200, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    good = [(0, [1.0, 0.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0, 0.0]), (3, [3e38, 3e38, 0.0, 0.0]), (50, [1e-38, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, None, "x", 0, "x") for i, v in [*odd, *good]], SCHEMA)
    got = {}
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got == {0: [(1, 1.0), (50, 1.0), (3, 0.707107), (2, -1.0)], 50: [(0, 1.0), (1, 1.0), (3, 0.707107), (2, -1.0)]}
    assert vector_search.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_search.nearest(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
