"""Packing of documents into context windows of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import REMEMBERED, give_back, mapped, table
from .tokens import WORDS, vocabulary_path

WINDOW = 4096
TIERS = (4096, 2048, 1024, 512)  # context sizes, longest first, each a power of two
BLOCK = 4_000_000  # tokens packed together
STEP = 1 << 17  # tokens of a step group
BYTES = 1 << 19  # of texts encoded at once in a task
END = 2
SPECIAL = " "  # before a special string's id in place of a pre-token, which holds no blank


class Encoder:
    """Ids of texts by the tokenizers library's model, in one worker; pre-tokens are merged once while remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.v = bpe.Vocabulary(spec)
        self.model = Tokenizer.from_str(spec).model
        self.letters = bpe.byte_letters()
        self.pieces = bpe.Lexicon(self._merged, WORDS)
        self.words = bpe.Lexicon(self._split, WORDS)

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelt = (p if p[0] == SPECIAL or p == bpe.BREAK or (p.isascii() and p.isprintable()) else "".join(self.letters[b] for b in p.encode()) for p in pieces)
        ids = [[int(p[1:])] if p[0] == SPECIAL else [t.id for t in self.model.tokenize(p)] if p != bpe.BREAK else [] for p in spelt]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every = bpe.pieces_of_words(self.v, words)
        codes = self.pieces.codes([p if isinstance(p, str) else f"{SPECIAL}{p}" for p in every])
        return self.pieces.pieces(codes), np.add.reduceat(self.pieces.size[codes], np.flatnonzero(codes == codes[0]))  # a break has no ids

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number. Arrow finds the distinct stretches, so that only those become Python strings."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if pc.any(pc.match_substring_regex(texts, bpe.WIDE)).as_py():
            texts = pc.replace_substring_regex(texts, bpe.WIDE, " ")
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        codes = self.words.codes(each.dictionary.to_numpy(zero_copy_only=False).tolist())[each.indices.to_numpy()]
        return self.words.pieces(codes), bpe.sums(self.words.size[codes], words.value_lengths().to_numpy())


@lru_cache(1)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


REMEMBERED[__name__] = encoder.cache_clear


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (size, pieces), a piece as (document, start, length).

    Whole windows are cut off a long document first. What remains is routed to
    the smallest tier that holds it. Tiers are packed from the longest: a window
    starts with its tier's next document, its gap takes the largest documents
    that fit from this and the shorter tiers, and what gap is left takes the
    front of a longer one. The shortest tier's rest ends in windows of smaller
    powers of two, so that no window needs padding.
    """
    top = tiers[0]
    out, rest = [], []
    for d, n in enumerate(lengths):
        out += [(top, [(d, s, top)]) for s in range(0, n - top + 1, top)]
        if n % top:
            rest.append((n % top, d, n - n % top))
    rest.sort()
    left = sum(n for n, _, _ in rest)
    for size in [*tiers, *(1 << k for k in reversed(range(tiers[-1].bit_length() - 1)))]:
        shortest = size <= tiers[-1]
        while left >= size and rest and (shortest or rest[-1][0] > size // 2):
            gap, pieces = size, []
            while gap:
                i = bisect_right(rest, (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    n, d, s = rest.pop(i)
                else:  # all that is left is longer than the gap: cut the shortest
                    n, d, s = rest.pop(0)
                    insort(rest, (n - gap, d, s + gap))
                    n = gap
                pieces.append((d, s, n))
                gap -= n
            out.append((size, pieces))
            left -= size
    return out


def parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (null: empty) of a bounded number of bytes at once, ``most`` and what the first text has beyond."""
    for b in batches:
        texts = b.column(1).fill_null("")
        at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // most
        for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), b.num_rows]):
            if hi > lo:
                yield b.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo)


def own_copy(keys: pa.Array) -> pa.Array:
    """The same values in memory of their own. A batch from Spark is one piece of memory: its keys would keep its texts."""
    return keys.take(pa.array(np.arange(len(keys))))


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    A document is the ids of its whole text (null: empty) by the tokenizers file
    at ``path``, then the end id; an empty text is the end id alone. Each task
    packs blocks of a bounded number of tokens from its own rows, so nothing is
    shuffled or gathered; a block pads nothing (see ``pack``). Windows are dealt
    by falling size to step groups of equal token sums; the last of a block may be
    smaller. Repeated rows are packed like others; an empty table gives an empty
    result; further columns are ignored. Ids of sequences and steps hold the
    task, block and place.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())  # the vocabulary file, a few MB

    def block(task: int, number: int, keys: list[pa.Array], ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        key = pa.concat_arrays(keys)
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        first = np.cumsum(size) - size
        packed = pack(size.tolist())
        packed.sort(key=lambda w: -w[0])
        tier = np.array([w for w, _ in packed], np.int64)
        step = (np.cumsum(tier) - tier) // STEP
        n = np.array([len(p) for _, p in packed])
        d, s, m = np.array([p for _, ps in packed for p in ps], np.int64).reshape(-1, 3).T
        end = np.cumsum(m)
        seq = np.repeat(np.arange(len(packed)), n)
        offset = end - m - (np.cumsum(tier) - tier)[seq]
        crc = [zlib.crc32(flat[a : a + k].astype("<u4").tobytes()) for a, k in zip((first[d] + s).tolist(), m.tolist(), strict=True)]
        base = (task << 40) + (number << 24)
        cols = [key.take(pa.array(d)), pa.array(s), pa.array(m), pa.array(crc, pa.int64()), pa.array(size[d]), pa.array(seq + base), pa.array(offset), pa.array(tier[seq]), pa.array(step[seq] + base)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(spec.value)
        task, number, held = TaskContext.get().partitionId(), 0, ([], [], [])
        for keys, texts in parts(batches, BYTES):
            ids, n = coder.encode(texts)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, END)
            for x, y in zip(held, (own_copy(keys), ids, n + 1), strict=True):
                x.append(y)
            if sum(map(len, held[1])) >= BLOCK:
                yield block(task, number, *held)
                number, held = number + 1, ([], [], [])
                give_back()
        if held[0]:
            yield block(task, number, *held)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"
    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
