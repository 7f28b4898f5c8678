"""SimHash near-dedup: tiled exact comparison of fingerprints by exclusive-or and bit counts; near copies by SimHash classes and exact similarity."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, components, durable, mapped, own_key, shared_folder, table

SEED = 42
WORDS = 100_000  # words whose hashes a worker remembers
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HOME, VISITORS = 1 << 14, 1 << 17  # rows of the two sides of a comparison task
PAIRS = 1 << 22  # pairs compared at once


def word_shingles(text: str | None, k: int) -> list[bytes]:
    """k-word shingles with repeats; all words if there are fewer; none without words."""
    words = (text or "").encode().translate(LOWER).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [flat[s:e] for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 128 * 128  # sums of 128 fit in a byte
        counts += bits[:full].reshape(-1, 128, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int, parts: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (shingles) and f0.. (64-bit words as longs) for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], [[] for _ in range(parts)]
            for t in b.column(1):
                found = word_shingles(t.as_py(), k)
                n.append(len(found))
                for j in range(parts):
                    h = np.array([xxhash.xxh64_intdigest(s, SEED + j) for s in found], np.uint64)
                    out[j].append(majority(h))
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *prints], ["doc_id", "n", *(f"f{j}" for j in range(parts))])

    schema = "doc_id long, n long, " + ", ".join(f"f{j} long" for j in range(parts))
    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indexes of links that span what all links (a, b) join, nearest links first."""
    root, kept = np.arange(n), []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while True:
            ra, rb = root[a[at]], root[b[at]]
            at, ra, rb = (x[ra != rb] for x in (at, ra, rb))
            if not len(at):
                break
            hi, first = np.unique(np.maximum(ra, rb), return_index=True)
            kept.append(at[first])
            root[hi] = np.minimum(ra, rb)[first]
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def forests(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Indexes of k spanning forests without a common link; what isn't in them is joined k times over by nearer links."""
    rest, kept = np.arange(len(a)), []
    for _ in range(k):
        f = forest(n, a[rest], b[rest], d[rest])
        kept.append(rest[f])
        rest = np.delete(rest, f)
    return np.concatenate(kept)


def links(nodes: DataFrame, near_tiles: list[int], radius: int, parts: int = 1, k: int = 1) -> DataFrame:
    """Links (a, b) that span all pairs of ``nodes`` at ``radius`` or fewer differing bits.

    ``nodes``: id, tile, f0.., one row per distinct fingerprint. A pair is compared
    when its tiles are equal or differ by one of ``near_tiles``; other tile pairs
    are skipped. Each task compares a block of one tile with a block of its
    neighbours, both of bounded size however many rows a tile has, and returns k
    disjoint spanning forests of the links it found, never all pairs of a group.
    """
    words = [f"f{j}" for j in range(parts)]
    steps = F.array(*[F.lit(x) for x in [0, *near_tiles]])
    size = nodes.groupBy("tile").agg(F.count("*").alias("rows"))
    moved = lambda df: df.withColumn("step", F.explode(steps)).withColumn("tile", F.col("tile") + F.col("step")).drop("step")
    come = moved(size).groupBy("tile").agg(F.sum("rows").alias("visitors"))
    # One row per tile: the number of population-count combinations or length bands, not of documents.
    plan = durable(
        size.join(come, "tile").select("tile", F.ceil(F.col("rows") / HOME).cast("int").alias("hs"), F.ceil(F.col("visitors") / VISITORS).cast("int").alias("vs"))
    )
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = nodes.join(plan, "tile").select("tile", salt("hs").alias("h"), every("vs").alias("v"), F.lit(True).alias("home"), "id", *words)
    visit = moved(nodes).join(plan, "tile")
    visit = visit.select("tile", every("hs").alias("h"), salt("vs").alias("v"), F.lit(False).alias("home"), "id", *words)

    def compare(t: pa.Table) -> pa.Table:
        home = t.column("home").to_numpy()
        ids = t.column("id").to_numpy()
        cols = [t.column(w).to_numpy().view(np.uint64) for w in words]
        x, y = np.flatnonzero(home), np.flatnonzero(~home)
        lab = np.unique(ids, return_inverse=True)[1]
        found = []
        step = max(1, PAIRS // max(1, len(y)))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            d = np.bitwise_count(cols[0][part, None] ^ cols[0][None, y])
            for c in cols[1:]:
                d = d + np.bitwise_count(c[part, None] ^ c[None, y])
            i, j = np.nonzero(d <= radius)
            if len(i):
                a, b, dist = part[i], y[j], d[i, j]
                differ = ids[a] != ids[b]
                a, b, dist = a[differ], b[differ], dist[differ]
                if len(a):
                    f = forests(len(ids), lab[a], lab[b], dist, k)
                    found.append((a[f], b[f], dist[f]))
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b, dist = (np.concatenate(z) for z in zip(*found, strict=True))
        f = forests(len(ids), lab[a], lab[b], dist, k)
        return pa.table({"a": ids[a[f]], "b": ids[b[f]]})

    return home.unionByName(visit).groupBy("tile", "h", "v").applyInArrow(compare, "a long, b long")


#: Steps between packed quarter populations that are up to 3 bits apart in all, one of each pair of opposites.
QUARTER_STEPS = sorted(
    {
        s
        for x in itertools.product(range(-3, 4), repeat=4)
        if 0 < sum(map(abs, x)) <= 3 and (s := sum(v << 5 * i for i, v in enumerate(x))) > 0
    }
)


def quarter_tile(f: str):
    """The populations of the four 16-bit quarters in one integer. Fingerprints that differ in r bits differ by r or less there in all."""
    count = lambda i: F.bit_count(F.shiftrightunsigned(f, 16 * i).bitwiseAND(F.lit(0xFFFF))) + 4
    return sum((F.shiftleft(count(i).cast("int"), 5 * i) for i in range(1, 4)), count(0).cast("int"))


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """f0 and component_id, the smallest id reachable at 3 or fewer differing bits a step, of each distinct f0 of ``prints`` (id, f0)."""
    nodes = durable(prints.groupBy("f0").agg(F.min("id").alias("id")))
    found = links(nodes.where("id is not null").withColumn("tile", quarter_tile("f0")), QUARTER_STEPS, 3)
    classes = components(found)
    rooted = nodes.join(classes, nodes.id == classes.node, "left").select("f0", F.coalesce("root", "id").alias("component_id"))
    return durable(rooted)


def simhash_classes(docs: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs``.

    64-bit SimHash over k-word shingles; fingerprints link at 3 or fewer
    differing bits; component_id is the smallest doc_id reachable. Texts without
    words (null, empty, blank) have fingerprint zero and link like any other.
    Equal fingerprints are compared once, so copies cost nothing. Repeated rows
    give repeated results; an empty table gives an empty result; further columns
    are ignored.
    """
    prints = durable(fingerprints(docs, k, 1, doc_id, text))
    classes = fingerprint_classes(prints.select(F.col("doc_id").alias("id"), "f0"))
    return prints.join(classes, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


# --- near duplicates of the pipeline ----------------------------------------

SAMPLE = 10_000  # texts in which common shingles are looked for
COMMON = 200_000  # shingles that are known as common, at most
BLOCK = 2_000  # members of a token on each side of a comparison
PIVOTS = 4  # members of a token that all others are compared with first
HOT = 1_000  # pairs of one text that are given one copy of it
FEW = 1_000_000  # ids that are broadcast, at most
CACHE = 1 << 20  # shingles of texts that a worker remembers
SKETCH = 256  # bits of parities that go with every token


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again. Unlike a checkpoint's, its size is the true one: estimates of joins multiply, round by round."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/near-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove what ``settled`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class _Words(dict):
    """Hashes of words, remembered; emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()
REMEMBERED[__name__] = _words.clear
STEP, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles (all words if there are fewer), ascending; from hashes of the words."""
    words = (text or "").encode().translate(LOWER).split()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n if len(w) else 0, min(len(w), k), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(w))):
            h = h * STEP + w[j : j + n]
        h ^= h >> np.uint64(31)
        h *= STIR
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` parities, each of the hashes that fall on it. Two sets' sketches differ in no more bits than the sets in elements."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def wide_bits(n: int) -> int:
    """Bits of the second sketch of a set: at least twice its elements, a power of two."""
    return 1 << max(0, 2 * n - 1).bit_length()


PRINT = ", ".join(f"p{j} long" for j in range(SKETCH // 64))


def _sets(least: float, k: int, common, bits_k: int | None = None):
    """Of each text its shingle set's size, identity, sketches and rarest shingles, as many that two sets of similarity ``least`` can't but share one.

    With ``bits_k`` also the SimHash of its shingles of so many words, as in ``fingerprints``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for b in batches:
            n, s, p, wide, tokens, f = [], [], [], [], [], []
            for t in b.column(1):
                h = shingle_set(t.as_py(), k)
                n.append(len(h))
                if bits_k:
                    f.append(majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in word_shingles(t.as_py(), bits_k)], np.uint64)))
                s.append(xxhash.xxh3_128_digest(h.tobytes()))
                p.append(sketch(h, SKETCH).view(np.int64))
                wide.append(sketch(h, wide_bits(len(h))).tobytes() if 2 * len(h) > SKETCH else None)
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, often[at], 0)
                tokens.append(h[np.lexsort((h, rank))[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]].view(np.int64))
            s = np.frombuffer(b"".join(s), np.int64).reshape(-1, 2)
            p = np.array(p, np.int64).reshape(-1, SKETCH // 64)
            cols = [pa.array(x) for x in (s[:, 0], s[:, 1], *(np.ascontiguousarray(c) for c in p.T))]
            cols += [pa.array(wide, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
            names = ["id", "n", "s0", "s1", *(f"p{j}" for j in range(SKETCH // 64)), "wide", "tokens"]
            if bits_k:
                cols, names = [*cols, pa.array(np.array(f, np.uint64).view(np.int64))], [*names, "f0"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *cols], names)

    return run


def apart(least: float) -> float:
    """Of two sets of similarity ``least``, the share of both sets' elements that may be in one of them only."""
    return (1 - least) / (1 + least)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose wide sketches allow them to be alike; the wider one of two is folded."""
    for b in batches:
        keep = []
        for least, n, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
            if x.is_valid and y.is_valid:
                x, y = (np.frombuffer(z.as_buffer(), np.uint8) for z in (x, y))
                while len(x) != len(y):
                    x, y = sorted((x, y), key=len)
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= apart(least) * n + 1e-6)
            else:
                keep.append(True)
        yield b.select(["a", "b", "least"]).filter(pa.array(keep, pa.bool_()))


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), k).view(np.int64))], ["token"])

    return run


def _alike(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        held = 0

        def shingles(text: pa.Scalar) -> np.ndarray:
            nonlocal held
            key = xxhash.xxh3_128_digest(text.as_buffer())
            if key not in seen:
                if held > CACHE:
                    seen.clear()
                    held = 0
                seen[key] = shingle_set(text.as_py(), k)
                held += len(seen[key])
            return seen[key]

        for b in batches:
            keep = []
            for least, x, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                s, t = shingles(x), shingles(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both >= least * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in three or more of about SAMPLE distinct texts, ascending, and in how many. They only set the order of shingles."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 40)) < int((1 << 40) * share))
    some = some.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    found = mapped(some, _tokens(k), "token long").groupBy("token").agg(F.count("*").alias("n"))
    rows = found.where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
    known = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], rows["n"].to_numpy(np.int64)[order]


def _with_text(pairs: DataFrame, side: str, texts: DataFrame, name: str) -> DataFrame:
    """Pairs with the text of one side; a text of many pairs is given out in several copies, each to a task of its own."""
    want = durable(pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count("*") / HOT).cast("int").alias("copies")))
    hot = want.where("copies > 1")
    few = want.count() <= FEW
    hot = F.broadcast(hot) if few or hot.count() <= FEW else hot
    copies = F.coalesce("copies", F.lit(1))
    left = pairs.join(hot.withColumnRenamed("id", side), side, "left").withColumn("copy", F.pmod(F.xxhash64("a", "b"), copies).cast("int")).drop("copies")
    right = texts.join(F.broadcast(want) if few else want, "id")
    right = right.select(F.col("id").alias(side), F.coalesce("text", F.lit("")).alias(name), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    return left.join(right, [side, "copy"]).drop("copy")


def joined(groups: list[tuple[DataFrame, float, bool]], texts: DataFrame, nodes: DataFrame, k: int, sure: DataFrame | None = None) -> DataFrame:
    """Links (a, b), each confirmed, that join all pairs under one token at its group's similarity or more; ``sure``, links known before, are among them.

    ``groups``: members, similarity, nearest. Members: token, m (its members), id, pos (shingles before the token), n and
    the sketch, as ``settled`` gives them; they are removed when done. First each is checked with a few pivots of its token, which settles
    groups of copies at some rows a member and token; in the end every pair that shares a
    token, fits and is neither joined by confirmed links nor rejected is checked. The pairs of all groups
    are checked at once, one of several groups at its least similarity. With
    nearest, for members of one token each, a member is checked first with only that
    pivot whose sketch is nearest, and the pivots with each other.
    """
    prints = [f"p{j}" for j in range(SKETCH // 64)]
    side = ["id", "n", "pos", *prints, "root"]

    def bits(x, y):
        return sum((F.bit_count(F.col(x + p).bitwiseXOR(F.col(y + p))) for p in prints), F.lit(0))

    def fits(x, y, similarity):
        """Whether sizes, places of the token and sketches allow two sets to be alike; a pair that it refuses under their first common token can't be."""
        n, o = F.col(x + "n"), F.col(y + "n")
        both = F.lit(similarity / (1 + similarity)) * (n + o) - 1e-6  # shingles that alike sets share, at least
        left = F.least(n - F.col(x + "pos"), o - F.col(y + "pos"))
        return (F.least(n, o) >= F.lit(similarity) * F.greatest(n, o)) & (left >= both) & (bits(x, y) <= F.lit(apart(similarity)) * (n + o) + 1e-6)

    rares, checked = [members.withColumn("root", F.col("id")) for members, _, _ in groups], None
    for last in (False, True):
        pairs = None
        for rare, (_, similarity, nearest) in zip(rares, groups, strict=True):
            if last:
                # Only tokens whose texts aren't all joined yet.
                per = rare.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("roots"))
                few = rare.join(per.where("roots > 1").withColumn("token", own_key("token")), "token", "left_semi")
                blocks = F.ceil(F.col("m") / BLOCK).cast("int")
                part = F.pmod(F.xxhash64("id"), blocks).cast("int")
                every = F.explode(F.sequence(F.lit(0), blocks - 1))
                own = lambda x: F.struct(*side).alias(x)
                left, right = few.select("token", part.alias("s"), every.alias("t"), own("x")), few.select("token", every.alias("s"), part.alias("t"), own("y"))
                met = left.join(right, ["token", "s", "t"]).where("x.id < y.id and x.root <> y.root").where(fits("x.", "y.", similarity))
                x, y = "x.id", "y.id"
            else:
                ps = F.array(*[F.min_by(F.struct(*side), F.xxhash64("id", F.lit(i))) for i in range(PIVOTS)])
                pivots = rare.groupBy("token").agg(ps.alias("ps")).withColumn("token", own_key("token"))
                met = rare.join(pivots, "token").withColumn("p", F.explode("ps")).where("id <> p.id").where(fits("", "p.", similarity))
                if nearest:
                    own = F.when(F.array_contains("ps.id", F.col("id")), F.col("p.id"))  # a pivot keeps all its pairs
                    met = met.groupBy("id", own.alias("own")).agg(F.min(F.struct(bits("", "p.").alias("bits"), F.col("p.id").alias("id"))).alias("p"))
                x, y = "id", "p.id"
            met = met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(similarity).alias("least"))
            pairs = met if pairs is None else pairs.union(met)
        pairs = pairs.groupBy("a", "b").agg(F.min("least").alias("least"))
        if checked is not None:
            was = checked.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("least").alias("at"))
            pairs = pairs.join(was, F.expr("a = c and b = d and at <= least"), "left_anti")
        pairs = settled(pairs)
        wide = nodes.select("id", "n", "wide")
        for end, x in (("a", "x"), ("b", "y")):
            pairs = pairs.join(wide.select(F.col("id").alias(end), F.col("n").alias(f"n{x}"), F.col("wide").alias(x)), end)
        pairs = mapped(pairs.select("a", "b", "least", F.expr("nx + ny"), "x", "y"), _possible, "a long, b long, least double")
        checked = settled(pairs.distinct())
        held = _with_text(_with_text(checked, "a", texts, "x"), "b", texts, "y")
        new = settled(mapped(held.select("a", "b", "least", "x", "y"), _alike(k), "a long, b long"))
        sure = new if sure is None else sure.union(new)
        if not last and not sure.isEmpty():
            roots = durable(components(sure).select(F.col("node").alias("id"), F.col("root").alias("_root")))
            for g, before in enumerate(rares):
                rares[g] = settled(before.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("_root", "id")).drop("_root"))
                discard(before)
    for rare in rares:
        discard(rare)
    return sure


def token_members(nodes: DataFrame) -> DataFrame:
    """Members of the tokens of ``nodes``, as ``joined`` takes them.

    Texts whose shingle sets are similar share one of their few rarest
    shingles, by any common order of shingles (prefix filter), so only texts under
    one token meet, and only where their first common token leaves enough shingles in
    both to be alike (positional filter).
    """
    rare = nodes.select("id", F.posexplode("tokens").alias("pos", "token"))
    # Counted by 32 bits of a token: who shares them by chance is found out below.
    bucket = F.hash("token")
    often = rare.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("m")).where("m > 1").select(F.col("bucket").bitwiseXOR(F.lit(0)).alias("bucket"))
    every_rare = rare = settled(rare.withColumn("bucket", bucket).join(often, "bucket", "left_semi").select("id", "token", "pos"))
    # Of tokens with the same members one is enough: the first in the order, which all members share.
    sets = rare.groupBy("token").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"), F.min(F.struct("id", "pos"))["pos"].alias("at")
    )
    one = sets.where("m > 1").groupBy("m", "x", "y").agg(F.min_by("token", "at").alias("token")).select(own_key("token").alias("token"), "m")
    rare = settled(rare.join(one, "token").join(nodes.select("id", "n", *(f"p{j}" for j in range(SKETCH // 64))), "id"))
    discard(every_rare)
    return rare


def class_members(nodes: DataFrame) -> DataFrame:
    """Members of the SimHash classes of ``nodes`` (as in ``simhash_classes``: fingerprints at 3 or fewer differing bits a step), as ``joined`` takes them; a class is a token."""
    member = nodes.join(fingerprint_classes(nodes.select("id", "f0")), "f0")
    member = member.select(F.col("component_id").alias("token"), "id", F.lit(0).alias("pos"), "n", *(f"p{j}" for j in range(SKETCH // 64)))
    often = member.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select(own_key("token").alias("token"), "m")
    return settled(member.join(often, "token"))


def near_links(texts: DataFrame, nodes: DataFrame, k: int, similarity: float, likeness: float | None = None) -> DataFrame:
    """Links (a, b) between ids of ``nodes``, each confirmed, that join all pairs at ``similarity`` or more.

    With ``likeness`` SimHash comes first: what a class holds is joined as far as it is alike by ``likeness``
    or more. A shingle of over half of a text sets all its bits, and two shingles set few, so unlike texts may
    share a class. Equal sets of different fingerprints are joined in any class.
    """
    if likeness is None:
        return joined([(token_members(nodes), similarity, False)], texts, nodes, k)
    low = nodes.groupBy("s0", "s1", "n").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    equal = settled(nodes.select("s0", "s1", "n", F.col("id").alias("a")).join(low, ["s0", "s1", "n"]).where("a <> b").select("a", "b"))
    return joined([(class_members(nodes), likeness, True), (token_members(nodes), similarity, False)], texts, nodes, k, equal)


def _first_of_groups(docs: DataFrame, k: int, similarity: float, likeness: float | None, doc_id: str, text: str) -> DataFrame:
    have = docs.where(F.col(doc_id).isNotNull())
    texts = have.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, k))
    schema = f"id long, n long, s0 long, s1 long, {PRINT}, wide binary, tokens array<long>"
    one = ["s0", "s1", "n"]
    if likeness is not None:
        schema, one = f"{schema}, f0 long", [*one, "f0"]
    prints = mapped(texts, _sets(similarity, k, common, None if likeness is None else 3), schema)
    equal = [F.first(c).alias(c) for c in prints.columns[4:] if c not in one]  # in a group of one identity
    nodes = durable(prints.groupBy(*one).agg(F.min("id").alias("id"), *equal))
    sure = near_links(texts, nodes, k, similarity, likeness)
    stay = nodes.select("id").distinct().join(components(sure).where("node <> root").select(F.col("node").alias("id")), "id", "left_anti")
    keep = durable(stay.select(F.col("id").alias(doc_id)))
    return have.join(keep, doc_id, "left_semi").unionByName(docs.where(F.col(doc_id).isNull())).select(docs.columns)


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep of each group of near-duplicate documents the one with the smallest doc_id.

    Groups are the connected components of all pairs whose sets of k-word shingles
    have a Jaccard similarity of ``similarity`` or more (A-Z lower-cased). Texts with
    equal sets are one node; other pairs are found by ``near_links``, which misses none.

    Texts without words (null, empty, blank) are one group. Rows with a null doc_id are kept as they
    are. Repeated rows of one doc_id that stays all stay. Returns the rows of
    ``docs`` unchanged, with all their columns whatever these are called; an empty table stays empty. Of a
    very long text a worker holds the hashes of all shingles, 8 bytes a word, a few times over.
    """
    return _first_of_groups(docs, k, similarity, None, doc_id, text)


def drop_simhash_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, likeness: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep of each group of near-duplicate documents the one with the smallest doc_id; groups by SimHash, then by exact similarity.

    Texts of one SimHash class (``simhash_classes``) are one group as far as an exact check
    lets them: the members whose sets of k-word shingles have a Jaccard similarity of
    ``likeness`` or more are linked. What is as similar as ``similarity`` is linked whatever its
    fingerprints are, as in ``drop_near_copies``. Groups are the connected components of both
    kinds of links. Nulls, repeated rows, columns and memory are as there.
    """
    return _first_of_groups(docs, k, similarity, likeness, doc_id, text)
