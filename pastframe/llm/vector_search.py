"""Approximate nearest neighbours by cosine: an inverted multi-index, its centroid pairs traversed with a heap, entries reranked exactly."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

CENTROIDS = 128  # of each half; the index has their square of cells
SAMPLE, STEPS = 16_384, 10  # entries that the centroids are fitted on, rounds
PROBES, REACH = 256, 0.96  # sampled queries that set how far queries look, share of their true neighbours to reach
NEAREST = 5
BLOCK, VISITS = 8_192, 2_048  # entries and queries of a comparison task
AT_ONCE = 256  # queries compared at once in a task
SLACK = 1e-9  # cosines closer than this are computed anew before they are ordered


@dataclass
class Index:
    """Centroids of both halves, and how many entries a pair of them has."""

    first: np.ndarray
    second: np.ndarray
    rows: np.ndarray
    visit: float = 1.0  # share of all entries that a query visits

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_squared(h, c) for h, c in zip(_halves(unit), (self.first, self.second), strict=True))


def _halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, exactly, so that their squares neither overflow nor vanish; cosines stay as they are."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(c: pa.Array, dim: int) -> np.ndarray:
    return scaled(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in one order of summation wherever the rows stand."""
    dot = lambda a, b: (a * b).sum(1)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k-means of the sample, at most k; a centroid of nothing stays."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:k]]
    for _ in range(STEPS):
        near = _squared(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def traverse(d1: np.ndarray, d2: np.ndarray, rows: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first centroid, how many of the second centroids, nearest first) of the pairs with ``least`` entries that are nearest by summed distance.

    The heap holds for each first centroid that was reached its next pair. All pairs
    as near as the last one are visited too.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b, n = d1[o1].tolist(), d2[o2].tolist(), rows[np.ix_(o1, o2)].tolist()
    depth, heap, seen, last = [0] * len(a), [(a[0] + b[0], 0)], 0, np.inf
    while heap and (seen < least or heap[0][0] <= last):
        last, i = heapq.heappop(heap)
        seen += n[i][depth[i]]
        depth[i] += 1
        if depth[i] == 1 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1))
        if depth[i] < len(b):
            heapq.heappush(heap, (a[i] + b[depth[i]], i))
    return [(int(o1[i]), m) for i, m in enumerate(depth) if m]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and has no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0))


def _placed(index: Index, dim: int):
    """Entries with their two centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2 = index.distances(_unit(_matrix(b.column(0), dim)))
            cells = [pa.array(d.argmin(1).astype(np.int32)) for d in (d1, d2)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cells], ["vector", "ids", "c1", "c2"])

    return run


def _routes(index: Index, dim: int, least: int):
    """For each query and first centroid that it reaches, how many of the second ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2 = index.distances(_unit(_matrix(b.column(1), dim)))
            at, c1, depth = [], [], []
            for i in range(len(d1)):
                for c, m in traverse(d1[i], d2[i], index.rows, least):
                    at.append(i)
                    c1.append(c)
                    depth.append(m)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(c1, pa.int32()), pa.array(depth, pa.int32())], ["id", "vector", "c1", "depth"])

    return run


def best_of(x: np.ndarray, y: np.ndarray, ids: list[list[int]], own: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int, int, float]]:
    """(row of x, row of y, vec_id, cosine) of the k best of each row, ties to the smaller vec_id; ``score`` has cosines up to SLACK, -inf where not visited."""
    out = []
    want = min(k + 1, len(y))  # one may be the query itself
    bound = np.partition(score, len(y) - want, axis=1)[:, len(y) - want]
    for i, low in enumerate(bound):
        at = np.flatnonzero((score[i] >= low - SLACK) & (score[i] > -np.inf))
        exact = cosine(np.broadcast_to(x[i], (len(at), x.shape[1])), y[at])
        found = [(-s, v, j) for s, j in zip(exact.tolist(), at.tolist(), strict=True) for v in ids[j] if v != own[i]]
        out += [(i, j, v, -s) for s, v, j in heapq.nsmallest(k, found)]
    return out


def _compare(index: Index, dim: int, k: int):
    """The best of a block of one first centroid's entries for a share of the queries that reach it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_query = t.column("id").is_valid().to_numpy()
        q, e = t.filter(pa.array(is_query)), t.filter(pa.array(~is_query)).sort_by("c2")
        vectors = lambda x: _matrix(x.column("vector").combine_chunks() if x.column("vector").num_chunks != 1 else x.column("vector").chunk(0), dim)
        if not len(q) or not len(e):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        y, ids, c2 = vectors(e), e.column("ids").to_pylist(), e.column("c2").to_numpy()
        unit, starts = _unit(y), np.r_[np.flatnonzero(np.r_[True, c2[1:] != c2[:-1]]), len(c2)]
        every, own, depth = vectors(q), q.column("id").to_numpy(), q.column("depth").to_numpy()
        out = []
        for lo in range(0, len(every), AT_ONCE):
            x = every[lo : lo + AT_ONCE]
            ux, mine = _unit(x), own[lo : lo + AT_ONCE]
            order = np.argsort(_squared(_halves(ux)[1], index.second), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(x), 0), 1)
            reach = place < depth[lo : lo + AT_ONCE, None]
            score = np.full((len(x), len(y)), -np.inf)
            for s, z in zip(starts[:-1], starts[1:], strict=True):
                who = np.flatnonzero(reach[:, c2[s]])
                score[who, s:z] = ux[who] @ unit[s:z].T
            out += [(mine[i], v, s) for i, _, v, s in best_of(x, y, ids, mine, score, k)]
        who, what, near = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(what, pa.int64()), "score": pa.array(near, pa.float64())})

    return run


def _probe(probes: np.ndarray, own: np.ndarray, dim: int, k: int):
    """The true nearest of the sampled queries among a task's entries, with the entries' centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _unit(probes)
        for b in batches:
            y, ids = _matrix(b.column(0), dim), b.column(1).to_pylist()
            if not len(y):
                continue
            out = best_of(probes, y, ids, own, unit @ _unit(y).T, k)
            i, j, v, s = zip(*out, strict=True) if out else ((), (), (), ())
            at, cols = pa.array(j, pa.int64()), [pa.array(i, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, b.column(2).take(at), b.column(3).take(at)], ["probe", "vec_id", "score", "c1", "c2"])

    return run


def _first(df: DataFrame, group: str, k: int, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def build_index(entries: DataFrame, dim: int) -> tuple[Index, DataFrame]:
    """Centroids from a sample of SAMPLE entries (smallest hashes), every entry with its pair of them, and the number of rows of each pair."""
    some = entries.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").toArrow()
    unit = _unit(_matrix(some.column("vector").combine_chunks(), dim))
    index = Index(*(centroids(h, CENTROIDS) for h in _halves(unit)), rows=np.zeros((1, 1), np.int64))
    placed = durable(entries.mapInArrow(_placed(index, dim), "vector array<double>, ids array<long>, c1 int, c2 int"))
    index.rows = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in placed.groupBy("c1", "c2").agg(F.sum(F.size("ids")).alias("n")).collect():  # CENTROIDS squared, at most
        index.rows[r.c1, r.c2] = r.n
    return index, placed


def needed_share(index: Index, placed: DataFrame, queries: DataFrame, dim: int, k: int) -> float:
    """The share of all entries that queries have to visit to reach REACH of their true neighbours, from PROBES sampled queries compared with everything."""
    some = queries.orderBy(F.xxhash64("id"), "vector").limit(PROBES).toArrow()
    probes, own = _matrix(some.column("vector").combine_chunks(), dim), some.column("id").to_numpy()
    found = placed.mapInArrow(_probe(probes, own, dim, k), "probe int, vec_id long, score double, c1 int, c2 int")
    found = _first(found, "probe", k, [F.desc("score"), F.col("vec_id")]).toPandas()
    if found.empty:
        return 1.0
    d1, d2 = index.distances(_unit(probes))
    seen = []
    for i, of in found.groupby("probe"):
        d = d1[i][:, None] + d2[i][None, :]
        seen += [index.rows[d <= far].sum() for far in d[of["c1"], of["c2"]]]
    return float(np.quantile(np.array(seen), REACH, method="higher") / max(1, index.rows.sum()))


def nearest(df: DataFrame, queries: Column, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of largest cosine that each row under ``queries`` finds among all other rows.

    Each half of the unit vectors has its own centroids, fitted on a bounded sample;
    every row is indexed under its pair of them. A query goes through the pairs by
    summed distance until it has passed a share of all rows, and the exact cosine of
    what it met decides. The share is measured: a bounded number of queries is compared
    with everything, and theirs that reaches REACH of their neighbours holds for all. Vectors without
    structure need a large one (0.3 and more for uniform directions in 64 dimensions), clustered ones a small one.

    Equal vectors are one entry with their k + 1 smallest ids (no more can be among
    the k nearest of any query), so copies cost nothing; crowded centroids are cut
    into blocks and their queries dealt out. Ties go to the smaller id. Vectors null,
    zero, empty, with null or non-finite components, or of another length than that of the
    smallest usable id take no part, nor do rows with a null id. Repeated rows of one id
    are one row, or, if their vectors differ, each its own query and candidate of the others' ids only.
    An empty table, or no query, gives no rows. Further columns are ignored.
    """
    rows = usable(df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")), "vector").where("id is not null")
    head = rows.orderBy("id", "vector").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not head:
        return df.sparkSession.createDataFrame([], schema)
    dim = len(head[0].vector)
    rows = rows.where(F.size("vector") == dim)
    asks = rows.where("asks").select("id", "vector").distinct()
    entries = _first(rows.select("id", "vector").distinct(), "vector", k + 1, [F.col("id")]).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index, placed = build_index(entries, dim)
    index.visit = needed_share(index, placed, asks, dim, k)
    least = min(int(index.rows.sum()), max(k + 1, int(np.ceil(index.visit * index.rows.sum()))))
    routes = durable(asks.mapInArrow(_routes(index, dim, least), "id long, vector array<double>, c1 int, depth int"))
    # One row a centroid: bounded by CENTROIDS.
    blocks = F.broadcast(durable(placed.groupBy("c1").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("es"))))
    shares = F.broadcast(durable(routes.groupBy("c1").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("qs"))))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(blocks, "c1").join(shares, "c1")
    left = left.select("c1", salt("ids", "es").alias("e"), every("qs").alias("q"), F.lit(None).cast("long").alias("id"), "vector", "ids", "c2", F.lit(None).cast("int").alias("depth"))
    right = routes.join(blocks, "c1").join(shares, "c1")
    right = right.select("c1", every("es").alias("e"), salt("id", "qs").alias("q"), "id", "vector", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("c2"), "depth")
    found = left.unionByName(right).groupBy("c1", "e", "q").applyInArrow(_compare(index, dim, k), "query_id long, vec_id long, score double")
    return _first(found, "query_id", k, [F.desc("score"), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
