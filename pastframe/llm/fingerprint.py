"""Context-triggered piecewise hashes of documents and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

WINDOW = 7  # bytes of the rolling hash
LEAST = 3  # the smallest block size; others are this times a power of two
CHUNKS = 64  # the block size is the smallest that gives no more chunks
CHARS = 500_000  # characters hashed at once
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 20), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base]


def triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a chunk ends at the smallest block size, and how often their block size may double."""
    b = data.astype(np.uint32)
    c = np.r_[np.zeros(WINDOW, np.uint32), np.cumsum(b, dtype=np.uint32)]
    total = c[WINDOW:] - c[:-WINDOW]
    cc = np.r_[np.uint32(0), np.cumsum(c, dtype=np.uint32)]
    weighted = np.uint32(WINDOW) * c[WINDOW:] - (cc[WINDOW:-1] - cc[: -WINDOW - 1])
    mixed = b.copy()
    for k in range(1, WINDOW):
        mixed[k:] ^= b[:-k] << np.uint32(5 * k)
    v = (total + weighted + mixed).astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(v % np.uint64(LEAST) == 0)
    v = v[at]
    return at, np.bitwise_count((v & (~v + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def signature(sums: np.ndarray, lo: int, hi: int, ends: np.ndarray) -> str:
    """Two letters a chunk. ``sums``: prefix sums of byte times power, one longer than the data."""
    ends = ends + 1
    if not len(ends) or ends[-1] < hi:
        ends = np.append(ends, hi)
    starts = np.concatenate(([lo], ends[:-1]))
    h = (sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), hi + 1)[starts]
    h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)
    return LETTERS[np.stack([h >> np.uint64(6), h & np.uint64(63)], 1).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[str]) -> list[str]:
    """``block size:signature:signature at twice the block size`` of each text; equal texts have equal ones.

    A chunk ends where a rolling hash of 7 bytes is -1 modulo the block size.
    """
    gap = b"\0" * WINDOW
    data = [t.encode() for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(gap.join(data) + gap, np.uint8)
    lo = np.cumsum(size + WINDOW) - size - WINDOW
    at, level = triggers(flat)
    own = np.searchsorted(lo, at, "right") - 1
    inside = at < (lo + size)[own]
    at, level, own = at[inside], np.minimum(level[inside], 39), own[inside]
    many = np.bincount(own * 40 + level, minlength=40 * len(data)).reshape(-1, 40)[:, ::-1].cumsum(1)[:, ::-1]
    pick = np.argmax(many < CHUNKS, axis=1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat * powers(BASE, len(flat))[: len(flat)])))
    bounds = np.searchsorted(own, np.arange(len(data) + 1))
    out = []
    for i, (s, n, k) in enumerate(zip(lo.tolist(), size.tolist(), pick.tolist(), strict=True)):
        a, lev = at[bounds[i] : bounds[i + 1]], level[bounds[i] : bounds[i + 1]]
        two = [signature(sums, s, s + n, a[lev >= x]) if n else "" for x in (k, k + 1)]
        out.append(f"{LEAST << k}:{two[0]}:{two[1]}")
    return out


def likeness_of(x: str, y: str) -> float:
    """1 less the share of insertions and deletions that make one signature the other."""
    a, b = [x[i : i + 2] for i in range(0, len(x), 2)], [y[i : i + 2] for i in range(0, len(y), 2)]
    if not a or not b:
        return float(a == b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1  # zeros mark the common subsequence
    for c in b:
        if m := where.get(c):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: edit distance of the signatures at a block size that both have; 0 if there is none, 1 for equal fingerprints."""
    if x == y:
        return 1.0
    (p, x1, x2), (q, y1, y2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(likeness_of(x1, y1), likeness_of(x2, y2))
    return likeness_of(x1, y2) if p == 2 * q else likeness_of(x2, y1) if q == 2 * p else 0.0


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _all(texts: list[str]) -> list[str]:
    return [f for part in _slices(texts) for f in fingerprints(part)]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ahead, doc_id, text) in order; a row marked ahead only follows others."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple] = []
    for b in batches:
        ahead, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        texts = [t.as_py() or "" for t in b.column(2)]
        rows = held + list(zip(ahead, ids, texts, _all(texts), strict=True))
        held = rows[-1:]
        todo = [(x, y) for x, y in zip(rows, rows[1:]) if not x[0]]
        if todo:
            edited = [x[2][: len(x[2]) - len(x[2]) // 2] + y[2][: len(x[2]) // 2] for x, y in todo]
            prints = _all(edited)
            cols = [
                pa.array([x[1] for x, _ in todo], pa.int64()),
                pa.array([len(x[2]) for x, _ in todo], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([x[3] for x, _ in todo]),
                pa.array(prints),
                pa.array([likeness(x[3], p) for (x, _), p in zip(todo, prints, strict=True)], pa.float64()),
                pa.array([likeness(x[3], y[3]) for x, y in todo], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A document's edited text has its last half (rounded down) replaced by the
    start of the next document's text, in the order of doc_id, the first following
    the last. Rows are dealt once, by ranges of doc_id; the first row of a range is
    also given to the range before it, so that each task works through its rows
    in order with no others.

    Null text counts as empty; null doc_id comes first; rows of one doc_id are
    ordered by text. A single row follows itself. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    src = docs.select(key.alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # At most one boundary a partition comes to the driver; each is a doc_id of the table.
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    first, cuts = src.agg(F.min("key"), F.percentile_approx("key", shares, 10_000)).first()
    cuts = sorted({c for c in cuts or [] if c > first})
    last, step = len(cuts), 64
    if cuts:
        below = lambda a, x=F.col("key"): F.size(F.filter(a, lambda c: c <= x))
        coarse = F.lit(cuts[::step])
        block = F.greatest(below(coarse) - 1, F.lit(0)) * step
        bucket = block + below(F.slice(F.lit(cuts), block + 1, F.lit(step)))
        # A row that opens a range also closes the one before.
        opens = F.array_contains(F.slice(F.lit(cuts), block + 1, F.lit(step)), F.col("key"))
    else:
        bucket, opens = F.lit(0), F.lit(False)
    here = F.struct(bucket.cast("int").alias("b"), F.lit(False).alias("ahead"))
    before = F.when(opens, F.struct((bucket - 1).cast("int").alias("b"), F.lit(True).alias("ahead"))).when(
        F.col("key") == F.lit(first), F.struct(F.lit(last).alias("b"), F.lit(True).alias("ahead"))
    )
    dealt = src.select(F.explode(F.array_compact(F.array(here, before))).alias("to"), "key", "doc_id", "text")
    dealt = dealt.repartitionById(last + 1, "to.b").sortWithinPartitions("to.b", "to.ahead", "key", "text")
    return mapped(
        dealt.select("to.ahead", "doc_id", "text"),
        _in_order,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
