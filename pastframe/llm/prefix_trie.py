"""Prefix trie of conversations: vertical bitmaps per shard, intersected depth first, and the shards' nodes merged by path."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

SHARD = 1_024  # segments of a shard, and so bits of a bitmap
BAND = 64  # turns of a segment
HEAD, EVERY = 6, 100  # rebuilt conversations take less than HEAD turns of the last multiple of EVERY
NODE = "shard long, pre int, up int, size int, own boolean, depth long, k0 long, k1 long, p0 long, p1 long, n long, least long, len long, kids int, first long, ends string"
PARTIAL = "k0 long, k1 long, parent long, children long, leaves long, saved long, conv long, band long"


def numbered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, h0, h1, len) of each turn: texts go no further than their 128-bit hash and number of code points."""
    said = [F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))]
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.xxhash64(F.lit(1), *said).alias("h0"), F.xxhash64(F.lit(2), *said).alias("h1"), F.char_length(said[1]).cast("long").alias("len"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "h0", "h1")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).select("conv", "pos", "h0", "h1", "len")


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations, and for each of them a row at position 0 without a turn."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD))
    heads = own.where((F.col("conv") % EVERY == 0) & (F.col("pos") < HEAD)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.collect_list(F.struct("pos", "h0", "h1", "len")).alias("head"))
    convs = own.where("pos = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % EVERY).alias("base")).join(heads, "base", "left")
    start = F.array(F.struct(F.lit(0).cast("long").alias("pos"), *[F.lit(None).cast("long").alias(c) for c in ("h0", "h1", "len")]))
    taken = F.filter(F.coalesce("head", F.array()), lambda x: x["pos"] <= F.col("h"))
    return convs.select("conv", F.inline(F.concat(start, taken))).unionByName(own.where(F.col("pos") > h))


def segments(turns: DataFrame, length: int = BAND) -> DataFrame:
    """Conversations in segments of ``length`` turns: (conv, band, last, s0, s1, items), the turns with the keys of their paths.

    A path's key is the exclusive-or of 64-bit hashes of its (position, turn) pairs, twice; (s0, s1) is that of the path before the segment.
    """
    order = Window.partitionBy("conv").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"last": F.lead("pos").over(order).isNull(), "pos": F.row_number().over(order).cast("long") - 1})
    for i in (0, 1):
        rows = rows.withColumn(f"t{i}", F.when(F.col("pos") > 0, F.xxhash64(F.lit(i), "pos", "h0", "h1")).otherwise(0))
    rows = rows.withColumns({f"k{i}": F.bit_xor(f"t{i}").over(so_far) for i in (0, 1)})
    band = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / length).cast("long")
    before = F.min(F.struct("pos", F.col("k0").bitwiseXOR(F.col("t0")).alias("s0"), F.col("k1").bitwiseXOR(F.col("t1")).alias("s1")))
    # length + 1 items, at most.
    items = F.sort_array(F.collect_list(F.struct("pos", "h0", "h1", "k0", "k1", "len")))
    return rows.groupBy("conv", band.alias("band")).agg(F.max("last").alias("last"), before.alias("b"), items.alias("items")).select("conv", "band", "last", "b.s0", "b.s1", "items")


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def grow(shard: int, held: list[tuple], length: int = BAND) -> list[list]:
    """The nodes of a shard in pre-order: rows of NODE.

    ``held``: (conv, band, last, s0, s1, items). Bit i stands for the i-th smallest conversation.
    """
    held.sort(key=lambda s: s[:2])
    turns = [s[5] if s[1] else s[5][1:] for s in held]  # without the start of band 0
    postings = [defaultdict(int) for _ in range(length)]  # of each position: turn to segments
    stops, ends, starts = [0] * (length + 1), [0] * (length + 1), defaultdict(int)
    for i, (s, of) in enumerate(zip(held, turns, strict=True)):
        starts[s[1], s[3], s[4]] |= 1 << i
        stops[len(of)] |= 1 << i
        if s[2]:
            ends[len(of)] |= 1 << i
        for d, t in enumerate(of):
            postings[d][t["h0"], t["h1"]] |= 1 << i
    out, size = [], []
    for (band, s0, s1), bits in starts.items():
        stack = [(bits, 0, -1, s0, s1, None, None, 0)]
        while stack:
            bits, d, up, k0, k1, p0, p1, chars = stack.pop()
            at, kids, rest = len(out), [], bits & ~stops[d]
            while rest:
                t = turns[(rest & -rest).bit_length() - 1][d]
                child = bits & postings[d][t["h0"], t["h1"]]
                kids.append((child, d + 1, at, t["k0"], t["k1"], k0, k1, t["len"]))
                rest &= ~child
            own = d > 0 or band == 0
            here = [str(held[i][0]) for i in _bits(bits & ends[d])] if own else []
            least = held[(bits & -bits).bit_length() - 1][0]
            out.append([shard, at, up, 0, own, band * length + d, k0, k1, p0, p1, bits.bit_count() if own else 0, least if own else None, chars, len(kids), int(here[0]) if here else None, ",".join(here) if here else None])
            stack += reversed(kids)
    size = [1] * len(out)
    for i in range(len(out) - 1, -1, -1):
        if out[i][2] >= 0:
            size[out[i][2]] += size[i]
        out[i][3] = size[i]
    return out


def _shards(length: int, most: int):
    """Nodes of shards of ``most`` neighbouring segments."""
    kinds = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[kind]) for name, kind in (c.split(" ") for c in NODE.split(", "))])

    def nodes(shard: int, held: list[tuple]) -> pa.RecordBatch:
        rows = grow(shard, held, length)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], TaskContext.get().partitionId() << 32
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                if len(held) == most:
                    yield nodes(done, held)
                    held, done = [], done + 1
        if held:
            yield nodes(done, held)

    return run


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each shard, which come one after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        shard = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(lo, hi - lo)
            if held and part.num_rows and held[-1].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _subtrees(length: int):
    """What a shard adds to its nodes' children, leaves and saved tokens.

    Every node of the trie counts in one shard: where its smallest member is. What
    counts in a later band is also given by member, for the nodes above it.
    """
    names = [c.split(" ")[0] for c in PARTIAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_shards(batches):
            get = lambda c: t.column(c).to_numpy()
            up, size, least, band = get("up"), get("size"), get("all_least"), (get("depth") - 1) // length
            mine = get("own") & (pc.fill_null(t.column("least"), 0).to_numpy() == least)
            saved, leaves = np.where(mine, (get("all_n") - 1) * get("len"), 0), (mine & get("leaf")).astype(np.int64)
            total = lambda v: (c := np.r_[0, np.cumsum(v)])[np.arange(len(v)) + size] - c[:-1]
            children = np.bincount(up[mine & (up >= 0)], minlength=len(up))
            none = pa.nulls(len(up), pa.int64())
            parent = pa.array(least[np.maximum(up, 0)], pa.int64(), mask=up < 0)
            # The start of a later band is a node of the band before: only its children are counted here.
            own = get("own").astype(np.int64)
            yield pa.RecordBatch.from_arrays([t.column("k0").chunk(0), t.column("k1").chunk(0), parent, pa.array(children), pa.array(total(leaves) * own), pa.array(total(saved) * own), none, none], names)
            late = mine & (band > 0)
            if late.any():
                keys, at = np.unique(np.stack([least[late], band[late]], axis=1), axis=0, return_inverse=True)
                sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
                for s, v in zip(sums, (leaves, saved), strict=True):
                    np.add.at(s, at.ravel(), v[late])
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, *map(pa.array, sums), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's joined lists, which come in order; only the running hash is held."""
    at, run = None, None
    for b in batches:
        k0, k1, sums = [], [], []
        for key0, key1, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if at == (key0, key1):
                run.update(b"," + ids.encode())
                continue
            if run:
                k0.append(at[0])
                k1.append(at[1])
                sums.append(run.hexdigest())
            at, run = (key0, key1), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), pa.array(sums, pa.string())], ["k0", "k1", "sum"])
    if run:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([run.hexdigest()])], ["k0", "k1", "sum"])


def trie(parts: DataFrame, length: int = BAND, most: int = SHARD) -> DataFrame:
    """All nodes of the trie over conversations given as ``segments``."""
    keys = ["k0", "k1"]
    # Neighbours share long prefixes, and conversations that are equal to the end of a segment come by id.
    way = ["band", "s0", *[F.get("items", F.lit(i))["k0"] for i in (1, 2, 3, 5)], F.element_at("items", -1)["k0"], "conv"]
    nodes = durable(parts.repartitionByRange(*way).sortWithinPartitions(*way).mapInArrow(_shards(length, most), NODE))
    merged = nodes.groupBy(*keys).agg(
        F.sum("n").alias("all_n"), F.min("least").alias("all_least"), F.max("depth").alias("depth"), (F.max("kids") == 0).alias("leaf"),
        *[(F.min(c) != F.max(c)).alias(f"_{c}") for c in ("p0", "p1", "depth")],
    )
    clash = F.coalesce("_p0", F.lit(False)) | F.coalesce("_p1", F.lit(False)) | F.col("_depth")
    merged = durable(merged.withColumn("depth", F.when(clash, F.raise_error(F.lit("two paths have one key"))).otherwise(F.col("depth"))).drop("_p0", "_p1", "_depth"))
    back = nodes.select("shard", "pre", "up", "size", "own", *keys, "least", "len").join(merged, keys).select("shard", "pre", "up", "size", "own", "least", "len", *keys, "all_n", "all_least", "leaf", "depth")
    partial = durable(back.repartition("shard").sortWithinPartitions("shard", "pre").mapInArrow(_subtrees(length), PARTIAL))
    sums = partial.where("conv is null").drop("conv", "band")
    late = partial.where("conv is not null").groupBy("conv", "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    if not late.isEmpty():
        # To the nodes of a conversation's segment comes what it counts in later ones.
        later = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
        some = parts.join(late.select("conv").distinct(), "conv", "left_semi").join(late, ["conv", "band"], "left")
        some = some.select(F.col("items")["k0"].alias("x0"), F.col("items")["k1"].alias("x1"), *[F.sum(c).over(later).alias(c) for c in ("leaves", "saved")]).where("leaves > 0 or saved > 0")
        zero = F.lit(0).cast("long")
        sums = sums.unionByName(some.select(F.inline(F.arrays_zip(F.col("x0").alias("k0"), F.col("x1").alias("k1"))), F.lit(None).cast("long").alias("parent"), zero.alias("children"), "leaves", "saved"))
    sums = sums.groupBy(*keys).agg(F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    ends = nodes.where("ends is not null").select(*keys, "first", "ends").repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_ends, "k0 long, k1 long, sum string")
    return merged.join(sums, keys).join(ends, keys, "left").select(
        F.col("all_least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("all_n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sum", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", length: int = BAND, most: int = SHARD) -> DataFrame:
    """One row per node of the prefix trie over the rebuilt conversations.

    Turns are ordered by ``turn`` (null first; ties by the hash of role and text);
    null role or text counts as empty. Conversation c is rebuilt from the first h
    turns of conversation c - c % 100 and its own after its first h, h = crc32(c) % 6.
    Columns as ``trie`` gives them; conv_id is a node's smallest member.

    Turns travel as 128-bit hashes, and paths are merged by 128-bit keys (a clash of
    parents or depths under one key is an error), so long texts cost only their hashing. Conversations are
    cut into segments of ``length`` turns and those into shards of ``most`` segments, whatever
    their order: a hot first turn, or thousands of equal conversations, are divided
    over shards, a long conversation over segments. A conversation's turns are numbered by a
    window, which streams. Rows without a conversation id are left out; repeated rows are
    repeated turns; an empty table has no nodes; further columns are ignored.
    """
    own = durable(numbered_turns(df, conv_id, turn, role, text))
    return trie(durable(segments(rebuilt(own), length)), length, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS turn, length(coalesce(text, '')) AS len
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % {EVERY} AS base, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
  FROM (SELECT DISTINCT conv_id FROM own)),
head AS (SELECT conv_id, base, xor(crc, 4294967295) % {HEAD} AS h FROM conv),
taken AS (
  SELECT h.conv_id, o.pos, o.turn, o.len FROM head h JOIN own o ON o.conv_id = h.base AND o.pos <= h.h
  UNION ALL SELECT h.conv_id, o.pos, o.turn, o.len FROM head h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h),
whole AS (
  SELECT h.conv_id, coalesce(t.path, []) AS path, coalesce(t.lens, []) AS lens
  FROM head h LEFT JOIN (SELECT conv_id, list(turn ORDER BY pos) AS path, list(len ORDER BY pos) AS lens FROM taken GROUP BY conv_id) t USING (conv_id)),
node AS MATERIALIZED (
  SELECT path[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d > 0 THEN lens[d] ELSE 0 END) AS len,
    coalesce(string_agg(CASE WHEN len(path) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM whole, range(0, len(path) + 1) AS r(d) GROUP BY ALL),
kid AS (SELECT path[1:depth - 1] AS path, count(*) AS kids FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS MATERIALIZED (SELECT n.*, coalesce(k.kids, 0) AS kids FROM node n LEFT JOIN kid k ON n.path = k.path),
below AS (
  SELECT v.path, sum(CASE WHEN u.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.len) AS saved
  FROM full_node u, range(0, u.depth + 1) AS r(d) JOIN node v ON v.path = u.path[1:r.d] GROUP BY v.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.kids AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN below b USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
