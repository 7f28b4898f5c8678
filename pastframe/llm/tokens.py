"""BPE encoding and decoding, and token counts, over whole documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import REMEMBERED, mapped, table

CHARS = 2_000_000  # characters handled at once in a task
WORDS = 300_000  # words that a worker remembers
LIMIT = 2048


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Encoding and decoding with one vocabulary, in one worker."""

    def __init__(self, spec: str):
        self.v = v = bpe.Vocabulary(spec)
        self.merge = bpe.HeapMerger(v)
        self.pieces = bpe.Lexicon(self._merged, WORDS)
        self.units = bpe.Lexicon(self._split, WORDS)
        back = {c: b for b, c in enumerate(bpe.byte_letters())}
        text = [b""] * v.width
        for t, i in v.ids.items():
            text[i] = bytes(back[c] for c in t)
        for t, i in v.special.items():
            text[i] = t.encode()
        self.size = np.fromiter(map(len, text), np.int64, v.width)
        self.bytes, self.start = np.frombuffer(b"".join(text), np.uint8), np.cumsum(self.size) - self.size

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[self.v.special[p]] if p in self.v.special else self.merge(p.encode()) for p in pieces]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _split(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[u] if u in self.v.special else bpe.byte_pieces(self.v, u) for u in units]
        codes = self.pieces.codes([p for x in parts for p in x])
        return self.pieces.pieces(codes), bpe.sums(self.pieces.size[codes], [len(x) for x in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [bpe.byte_units(self.v, t) for t in texts]
        codes = self.units.codes([u for x in units for u in x])
        n = bpe.sums(self.units.size[codes], [len(x) for x in units])
        return np.split(self.units.pieces(codes), np.cumsum(n)[:-1])

    def decode(self, ids: np.ndarray) -> str:
        return bpe.gather(self.bytes, self.start, self.size, ids).tobytes().decode("utf-8", "replace")


class Counter:
    """Token counts with one vocabulary, in one worker."""

    def __init__(self, spec: str):
        self.v = bpe.Vocabulary(spec)
        self.merger = bpe.RankMerger(self.v)
        self.pieces = bpe.Lexicon(lambda new: (np.zeros(0, np.int32), self.merger.counts([p.encode() for p in new])), WORDS)
        self.words = bpe.Lexicon(self._count, WORDS)

    def _count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [bpe.word_pieces(self.v, w) for w in words]
        pieces = [[p for p in x if isinstance(p, str)] for x in split]
        codes = self.pieces.codes([p for x in pieces for p in x])
        n = bpe.sums(self.pieces.size[codes], [len(x) for x in pieces])
        return np.zeros(0, np.int32), n + np.array([len(x) - len(y) for x, y in zip(split, pieces, strict=True)], np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        words = [bpe.words_of(t) for t in texts]
        codes = self.words.codes([w for x in words for w in x])
        return bpe.sums(self.words.size[codes], [len(x) for x in words])


@lru_cache(1)
def coder(spec: str) -> Coder:
    return Coder(spec)


@lru_cache(1)
def counter(spec: str) -> Counter:
    return Counter(spec)


def _forget() -> None:
    coder.cache_clear()
    counter.cache_clear()


REMEMBERED[__name__] = _forget


def slices(batches: Iterator[pa.RecordBatch], most: int = CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (null: empty) of a bounded number of characters at once, ``most`` and the rest of the last text."""
    for b in batches:
        lo, chars, texts = 0, 0, []
        for i, t in enumerate(b.column(1)):
            texts.append(t.as_py() or "")
            chars += len(texts[-1])
            if chars >= most or i + 1 == b.num_rows:
                yield b.column(0).slice(lo, i + 1 - lo), texts
                lo, chars, texts = i + 1, 0, []


def encode_documents(docs: DataFrame, path: str, decode: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row.

    Byte-level BPE of the file at ``path``: special strings in a text are found
    first, then pre-tokens; each distinct one is merged by a priority queue of
    ranks over a doubly linked list, and remembered in a bounded lexicon while the
    worker lives. Decoding joins the vocabulary's strings. Null and
    empty texts give no ids and an empty text; repeated rows repeat; an empty
    table gives an empty result; further columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())  # the vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec.value)
        for keys, texts in slices(batches):
            ids = c.encode(texts)
            back = [c.decode(x) for x in ids] if decode else [None] * len(ids)
            size = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([keys, lists, pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, ids array<int>, decoded string")


def digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for b in batches:
        ids = b.column(1)
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        n = np.diff(ends)
        digests = [sha(flat[s:e].astype("<u4").tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        texts = [sha(t.as_py().encode()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def query_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return mapped(out, digest_ids, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    Word-level BPE of the file at ``path``. Pre-tokens that aren't remembered go
    in batches through flat arrays, in which each round merges every sequence's
    lowest-ranked pair; what is left is counted. Special strings count as one
    token. Null and empty texts have no bytes and tokens; repeated rows repeat;
    an empty table gives an empty result; further columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(spec.value)
        for keys, texts in slices(batches):
            total = c.count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(size, pa.int64()), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return mapped(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def query_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
