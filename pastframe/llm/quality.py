"""Quality classifier from weak labels: heuristic votes, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table
from .tokens import slices

SAMPLE = 4000  # distinct texts, about, that train the scorer
BITS = 14  # hashed features: 2^14
ROUNDS = 200
START = (0.05, 0.5)  # rates of junk votes before the first round: of all texts, of the kind that is a labeller's own
PRIOR = (1.0, 1.0)  # of a Beta distribution for each rate: one vote of each kind
CHARS = 1 << 20  # bytes hashed at once

#: Per labeller: a statistic, then the bounds of a good vote and of a junk vote, and the least words for a vote.
LABELLERS = [
    ("symbols", "<=", 0.02, ">=", 0.05, 8),  # share of characters that are neither letters, digits, blanks nor common punctuation
    ("capitals", "<=", 0.20, ">=", 0.50, 8),  # of ASCII letters
    ("echoes", "<=", 0.06, ">=", 0.20, 20),  # words equal to the one before
    ("fresh", ">=", 0.60, "<=", 0.35, 40),  # distinct among pairs of neighbouring words
    ("bars", "<=", 0.02, ">=", 0.15, 8),  # vertical bars a word
    ("shouts", "<=", 0.10, ">=", 0.40, 8),  # exclamation marks a word
    ("marks", "<=", 0.02, ">=", 0.15, 8),  # symbols at the end of a word, a word
    ("returns", "<=", 0.08, ">=", 0.20, 20),  # words equal to the one two places before
]
NAMES = [x[0] for x in LABELLERS]
#: Edges of the buckets in which the scorer sees the statistics.
EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
STATS = len(LABELLERS) * (len(EDGES) + 1)
WIDTH = (1 << BITS) + STATS

_COMMON = frozenset(b".,;:!?'\"()-+@/=_")
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_KIND = np.array([2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 0 if b > 127 or _BLANK[b] or b in b"0123456789" or b in _COMMON else 3 for b in range(256)], np.uint8)


def statistics(text: str) -> tuple[int, list[float]]:
    """Words, and the statistics of LABELLERS, over the whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    seen = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, seen, minlength=4)
    ends = np.count_nonzero((_KIND[data[:-1]] == 3) & _BLANK[data[1:]]) + int(len(data) > 0 and _KIND[data[-1]] == 3)
    words = text.split()
    n, after = len(words), words[1:]
    share = lambda a, b: float(a) / b if b else 0.0
    return n, [
        share(kinds[3], len(text)),
        share(kinds[2], kinds[1] + kinds[2]),
        share(sum(map(eq, words, after)), n),
        share(len(set(zip(words, after))), n - 1) if n > 1 else 1.0,
        share(seen[124], n),
        share(seen[33], n),
        share(ends, n),
        share(sum(map(eq, words, words[2:])), n),
    ]


def votes(words: int, stats: list[float]) -> str:
    """One letter a labeller: g(ood), j(unk) or - for no vote."""
    out = ""
    for x, (_, good_is, good, junk_is, junk, least) in zip(stats, LABELLERS, strict=True):
        holds = lambda how, bound, x=x: x <= bound if how == "<=" else x >= bound
        out += "-" if words < least else "g" if holds(good_is, good) else "j" if holds(junk_is, junk) else "-"
    return out


def estimate(patterns: dict[str, int], rounds: int = 1000) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of junk by vote pattern, each labeller's (junk votes of junk, junk votes of good) rates, the share of junk.

    Expectation-maximisation over the counts of patterns, of which there are at most
    3^labellers whatever the corpus. A text is good or one of as many kinds of junk as
    there are labellers; labellers vote independently given that, and no vote says
    nothing. All rates and shares are estimated: labellers that overlap tell each other's
    accuracies, since votes that fall together more often than chance need a kind of
    junk. The start is alike for all labellers and only says which kind is whose.
    """
    keys, k = list(patterns), len(LABELLERS)
    n = np.array([patterns[x] for x in keys], float)
    v = np.array([[{"j": 1.0, "g": 0.0, "-": np.nan}[c] for c in x] for x in keys]).reshape(len(keys), k)
    voted, junk = (~np.isnan(v)).astype(float), np.nan_to_num(v)
    rates = np.vstack([np.full(k, START[0]), np.where(np.eye(k), START[1], START[0])])
    first = weight = np.r_[0.9, np.full(k, 0.1 / k)]  # what a corpus without any vote is left with
    post = np.zeros((len(keys), k + 1))
    for _ in range(rounds if keys else 0):
        log = np.log(weight) + junk @ np.log(rates).T + (voted - junk) @ np.log(1 - rates).T
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
        mass = (n[:, None] * post).T
        weight = (mass.sum(1) + first) / (n.sum() + 1)
        rates = (mass @ junk + PRIOR[0]) / (mass @ voted + sum(PRIOR))
    bad = weight[1:] @ rates[1:] / weight[1:].sum()
    return dict(zip(keys, (1 - post[:, 0]).tolist(), strict=True)), np.stack([bad, rates[0]], axis=1), float(1 - weight[0])


def hashed(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text's byte triples, a bounded number at once."""
    data = np.frombuffer(text.encode(), np.uint8)
    for lo in range(0, len(data) - 2, CHARS):
        x = data[lo : lo + CHARS + 2].astype(np.uint32)
        yield ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)).astype(np.int64)


def junk_score(text: str, stats: list[float], w: np.ndarray, bias: float) -> float:
    """The scorer's sum: mean weight of the byte triples, weights of the buckets, bias."""
    total = size = 0
    for at in hashed(text):
        total, size = total + w[at].sum(), size + len(at)
    return float(bias + w[buckets(stats)].sum() + (total / size if size else 0.0))


def buckets(stats: list[float]) -> np.ndarray:
    return (1 << BITS) + np.arange(len(stats)) * (len(EDGES) + 1) + np.searchsorted(EDGES, stats)


def train(own: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, many: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of junk, by Adagrad steps. ``own``, ``at``, ``x``: text, feature, value; ``y``, ``many``: posterior, weight of a text."""
    w, bias = np.zeros(WIDTH), -2.0
    if not len(y):
        return w, bias
    sq, sq0 = np.full(WIDTH, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(own, w[at] * x, len(y)) + bias, -50, 50)))
        e = many * (p - y) / many.sum()
        g = np.bincount(at, e[own] * x, WIDTH) + 1e-6 * w
        sq += g * g
        sq0 += e.sum() ** 2
        w -= 0.3 * g / np.sqrt(sq)
        bias -= 0.3 * e.sum() / np.sqrt(sq0)
    return w, float(bias)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()
    for _, texts in slices(batches):
        found.update(votes(*statistics(t)) for t in texts)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["votes", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for many, texts in slices(batches):
        out = []
        for t in texts:
            n, stats = statistics(t)
            count = sum((np.bincount(at, minlength=1 << BITS) for at in hashed(t)), np.zeros(1 << BITS, np.int64))
            at = np.flatnonzero(count)
            x = count[at] / max(1, count.sum())
            out.append((np.r_[at, buckets(stats)].astype(np.int32), np.r_[x, np.ones(len(stats))].astype(np.float32), votes(n, stats)))
        cols = [pa.array([r[0] for r in out], pa.list_(pa.int32())), pa.array([r[1] for r in out], pa.list_(pa.float32())), pa.array([r[2] for r in out], pa.string())]
        yield pa.RecordBatch.from_arrays([many, *cols], ["n", "at", "x", "votes"])


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> tuple[np.ndarray, float, dict[str, float], np.ndarray]:
    """Weights, bias, posteriors by pattern and labeller rates. Votes are counted over all rows.

    The scorer is trained on about ``sample`` distinct texts, picked by a hash; a text
    that n rows have weighs 1 + log2(n), so that copies don't drown the others.
    """
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = mapped(src.select(F.lit(0).alias("none"), "text"), _patterns, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    patterns = {r.votes: r.n for r in counted.collect()}
    post, rates, _ = estimate(patterns)
    share = min(1.0, sample / max(1, src.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]))
    part = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 40)) < int((1 << 40) * share)
    some = src.where(part).groupBy(F.sha2("text", 256).alias("s")).agg(F.count("*").alias("n"), F.first("text").alias("text")).orderBy("s")
    rows = mapped(some.select("n", "text"), _features, "n long, at array<int>, x array<float>, votes string").toArrow().combine_chunks()
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, np.int32)
    own = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(rows["at"]).to_numpy() if rows.num_rows else 0)
    y = np.array([post.get(v, 0.0) for v in rows["votes"].to_pylist()])
    w, bias = train(own, flat("at"), flat("x"), y, 1 + np.log2(np.array(rows["n"].to_pylist(), float)))
    return w, bias, post, rates


def score_documents(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, votes (one letter per labeller), weak_junk (posterior of the votes), junk (the scorer's probability), kept.

    ``kept``: junk is under 0.5. Every row is scored from its whole text. The
    scorer sees shares of hashed byte triples and bucketed statistics. Null and
    empty texts get no votes and are kept unless the corpus itself says
    otherwise; repeated rows repeat; an empty table gives an empty result;
    further columns are ignored.
    """
    w, bias, post, _ = fit(docs, sample, text)
    model = docs.sparkSession.sparkContext.broadcast((w, bias, post))  # 2^14 weights and at most 3^labellers patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, post = model.value
        for keys, texts in slices(batches):
            said, junk = [], []
            for t in texts:
                n, stats = statistics(t)
                said.append(votes(n, stats))
                junk.append(float(1 / (1 + np.exp(-np.clip(junk_score(t, stats, w, bias), -50, 50)))))
            weak = [post.get(v, 0.0) for v in said]
            cols = [keys, pa.array(said, pa.string()), pa.array(weak, pa.float64()), pa.array(junk, pa.float64()), pa.array([j < 0.5 for j in junk], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "votes", "weak_junk", "junk", "kept"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(src, run, "doc_id long, votes string, weak_junk double, junk double, kept boolean")


def keep_good(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that the scorer keeps; rows with a null doc_id are judged by their texts like others."""
    w, bias, _, _ = fit(docs, sample, text)
    model = docs.sparkSession.sparkContext.broadcast((w, bias))
    names = docs.columns
    at_text = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        for b in batches:
            texts = (t.as_py() or "" for t in b.column(at_text))
            yield b.filter(pa.array([junk_score(t, statistics(t)[1], w, bias) < 0 for t in texts], pa.bool_()))

    return mapped(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
