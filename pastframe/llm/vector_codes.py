"""Vector code compression: product codes by integer k-means, nearest entries found with a GNAT over each codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SPLITS, LEAF = 8, 12  # split points of a node; entries of a node that is compared whole
LARGEST = 1 << 26  # integer components beyond it could overflow the squared distances of long vectors
EXACT = 1 << 20  # up to it, squared distances are exact in doubles
FEW = 100_000  # labels that are broadcast, at most
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of x and of y."""
    top = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if top < EXACT and x.shape[1] * 4 * int(top) ** 2 < 1 << 53:
        x, y = x.astype(np.float64), y.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in y], axis=1)


class Gnat:
    """Geometric near-neighbour access tree over integer entries; nearest() is exact, ties go to the lower index.

    A node has split points, and each other entry of it belongs to the nearest one.
    For every split point and every child the node knows the range of distances
    from the point to what is in the child (its own split point included).
    """

    def __init__(self, entries: np.ndarray, at: np.ndarray | None = None) -> None:
        at = np.arange(len(entries)) if at is None else at
        self.entries, self.children = entries, []
        if len(at) <= LEAF:
            self.splits = at
            return
        apart = squared(entries[at], entries[at])
        chosen, near = [0], apart[0].copy()
        for _ in range(SPLITS - 1):  # the one furthest from those chosen
            near[chosen] = -1
            chosen.append(int(near.argmax()))
            near = np.minimum(near, apart[chosen[-1]])
        chosen.sort()
        self.splits = at[chosen]
        owner = apart[:, chosen].argmin(1)
        owner[chosen] = np.arange(SPLITS)
        d = np.sqrt(apart[chosen].astype(np.float64))
        inside = [np.flatnonzero(owner == j) for j in range(SPLITS)]
        self.low = np.array([d[:, x].min(1) for x in inside]).T * DOWN
        self.high = np.array([d[:, x].max(1) for x in inside]).T * UP
        self.children = [Gnat(entries, rest) if len(rest := np.setdiff1d(at[x], self.splits)) else None for x in inside]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of q."""
        best, arg = np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(self.entries))
        self._visit(q, np.arange(len(q)), best, arg)
        return arg, best

    def _visit(self, q: np.ndarray, at: np.ndarray, best: np.ndarray, arg: np.ndarray) -> None:
        d2 = squared(q[at], self.entries[self.splits])
        first = d2.argmin(1)
        least, index = d2[np.arange(len(at)), first], self.splits[first]
        better = (least < best[at]) | ((least == best[at]) & (index < arg[at]))
        best[at[better]], arg[at[better]] = least[better], index[better]
        if not self.children:
            return
        d = np.sqrt(d2.astype(np.float64))
        for j, child in enumerate(self.children):  # the likeliest child of each, for a small radius
            if child and (here := at[first == j]).size:
                child._visit(q, here, best, arg)
        for j, child in enumerate(self.children):
            if child:
                radius = np.sqrt(best[at].astype(np.float64)) * UP * UP
                # Whatever is further than the radius from every entry of the child, and not equally far, is out.
                least = np.maximum((d * DOWN - self.high[:, j]).max(1), (self.low[:, j] - d * UP).max(1))
                here = at[(first != j) & (least <= radius)]
                if here.size:
                    child._visit(q, here, best, arg)


def kept(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and has no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) as integers, a row a vector."""
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a vector component exceeds {LARGEST // SCALE}, squared distances would overflow")
    return x.astype(np.int64)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def _sums(books: list[np.ndarray], dim: int):
    """Of each part and entry the count and the sum of what it is nearest to, in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        counts, sums = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), dim // PARTS), np.int64)
        for b in batches:
            for p, x in enumerate(_parts(whole(b.column(0), dim))):
                found, _ = trees[p].nearest(x)
                counts[p] += np.bincount(found, minlength=counts.shape[1])
                np.add.at(sums[p], found, x)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"],
            )

    return run


def _codes(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for b in batches:
            found = [t.nearest(x) for t, x in zip(trees, _parts(whole(b.column(2), dim)), strict=True)]
            code = np.stack([f for f, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(np.asarray(error, np.int64))],
                ["id", "label", "code", "error"],
            )

    return run


def fit_codebooks(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Integer codebooks after ``rounds`` of assignment and replacement over all rows of ``vectors`` (one column).

    ``start``: the rows that the codebooks start from. Tasks send one row per used
    entry, the driver receives PARTS x entries rows: the model, not the data.
    """
    dim, books = start.shape[1], _parts(start)
    for _ in range(rounds):
        found = vectors.mapInArrow(_sums(books, dim), "part int, entry int, n long, sums array<long>")
        total = found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dim // PARTS)]).alias("sums")
        )
        books = [b.copy() for b in books]
        for r in total.toLocalIterator():
            books[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return books


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of each kept row, and the codebooks.

    Dropped are rows whose vector is null, empty, of another length than that of
    the smallest kept vec_id, or holds null or non-finite components. Codebooks
    start from the 256 smallest vec_ids (null last, equal ids by their vectors); fewer rows give smaller
    codebooks. Repeated rows each count and return. An empty table gives no rows and
    no codebooks. Lengths that four doesn't divide and components beyond 65536 are an
    error. Further columns are ignored. Copies of one vector are as any other rows, no
    group is collected; of a label only its sum is.
    """
    rows = kept(df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")
    head = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not head:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    dim = len(head[0].vector)
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    rows = rows.where(F.size("vector") == dim)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    start = whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), dim)
    books = fit_codebooks(rows.select("vector"), start, rounds)
    kind = rows.schema["label"].dataType.simpleString()
    codes = durable(rows.mapInArrow(_codes(books, dim), f"id long, label {kind}, code string, error long"))
    total = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    total = F.broadcast(total) if total.count() <= FEW else total
    return codes.join(total, codes.label.eqNullSafe(total["_label"])).drop("_label"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    return f"""
near{n} AS MATERIALIZED (
  SELECT id, part, arg_min(entry, dist * 256 + entry) AS entry, min(dist) AS dist
  FROM (SELECT x.id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
        FROM cut x JOIN book{n} b ON x.part = b.part)
  GROUP BY id, part),
book{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN (
    SELECT part, entry, list((s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY pos) AS v FROM (
      SELECT part, entry, pos, sum(v[pos])::BIGINT AS s, count(*) AS n
      FROM near{n} JOIN cut USING (id, part), range(1, len(cut.v) + 1) AS r(pos) GROUP BY ALL)
    GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry),"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) AS r(part)),
book0 AS MATERIALIZED (
  SELECT part, (row_number() OVER (PARTITION BY part ORDER BY id) - 1) AS entry, v FROM cut
  QUALIFY entry < {ENTRIES}),{"".join(_round_sql(n) for n in range(ROUNDS + 1))}
codes AS (
  SELECT id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY id)
SELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes JOIN kept USING (id)
"""
