"""Byte-pair vocabularies for tokenizing inside tasks: two merge methods, and memos for what repeats."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import count, islice, pairwise

import numpy as np
import regex

#: White space of Unicode; Python's own also splits at 1C to 1F.
WHITE = "\t-\r \x85\xa0  -     　"
WIDE = f"[{WHITE[WHITE.index('\x85') :]}]"  # what of it is not ASCII
TOGETHER = 256  # words split at once into pre-tokens
_SPLIT = re.compile(f"[{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")

# The two vocabularies' patterns of pre-tokens.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""".replace(r"\s", f"[{WHITE}]").replace(
    r"\S", f"[^{WHITE}]"
)
BYTE_LEVEL = BYTE_LEVEL.replace(f"[^[{WHITE}]", f"[^{WHITE}")
BREAK = "\n"
WORD_LEVEL = rf"""'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: token ids, merges by rank, special strings, word end."""

    def __init__(self, text: str):
        self.text = text
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        self.width = max(max(self.ids.values()), *self.special.values()) + 1
        # A symbol is never merged at a lower rank than the one that makes it, so all places of a sequence's lowest pair merge at once.
        born = np.full(self.width, -1)
        np.maximum.at(born, self.made, np.arange(len(pairs)))
        self.ordered = bool((np.maximum(born[self.left], born[self.right]) < np.arange(len(pairs))).all())

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.text)
        return t.normalizer, t.pre_tokenizer, {c: b for b, c in enumerate(byte_letters())}

    def library_pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, by the library's own normalizer and pre-tokenizer."""
        normalizer, splitter, back = self._library
        text = normalizer.normalize_str(text) if normalizer else text
        return [bytes(map(back.__getitem__, p)).decode() for p, _ in splitter.pre_tokenize_str(text)]


class HeapMerger:
    """One pre-token at a time: a priority queue of merge ranks over a doubly linked symbol list."""

    def __init__(self, v: Vocabulary):
        self.first = v.first.tolist()
        self.rank = {int(a) << 20 | int(b): r for r, (a, b) in enumerate(zip(v.left, v.right, strict=True))}
        self.made = v.made.tolist()

    def __call__(self, data: bytes) -> list[int]:
        first, rank, made = self.first, self.rank.get, self.made
        sym = [first[b] for b in data]
        n = len(sym)
        if n < 2:
            return sym
        queue = []
        for i, (a, b) in enumerate(pairwise(sym)):
            if (r := rank(a << 20 | b)) is not None:
                queue.append(r << 32 | i)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            r, i = top >> 32, top & 0xFFFFFFFF
            a, j = sym[i], after[i]
            if a < 0 or j >= n or rank(a << 20 | sym[j]) != r:
                continue  # a stale entry: one of its symbols has been merged since
            s = sym[i] = made[r]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(s << 20 | sym[k])) is not None:
                    heappush(queue, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := rank(sym[h] << 20 | s)) is not None:
                heappush(queue, q << 32 | h)
        return [s for s in sym if s >= 0]


class RankMerger:
    """Many pre-tokens at once in flat arrays: each round applies every sequence's lowest-ranked pair at all its places."""

    def __init__(self, v: Vocabulary):
        if not v.ordered:
            raise ValueError("this vocabulary's merges can't be applied rank by rank")
        self.v = v
        keys = v.left * v.width + v.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], len(self.keys))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each (non-empty) word."""
        v, none = self.v, len(self.keys)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        out = size.copy()
        sym, ends = v.first[flat], np.cumsum(size) - 1
        sym[ends] = v.last[flat[ends]]
        live = np.flatnonzero(size > 1)
        own = np.repeat(np.arange(len(words)), size)
        keep = size[own] > 1
        sym, own = sym[keep], own[keep]
        while len(sym):
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rank = np.full(len(sym), none)
            inner = np.flatnonzero(own[1:] == own[:-1])
            rank[inner] = self.ranks(sym[inner] * v.width + sym[inner + 1])
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            out[live] = length
            low_each = np.repeat(low, length)
            at = np.flatnonzero((rank == low_each) & (rank < none))
            if len(at):  # in a run of touching places every second one merges
                run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                sym[at] = v.made[rank[at]]
            stay = low_each < none
            stay[at + 1] = False
            sym, own = sym[stay], own[stay]
            live = live[low < none]
        return out


def _numbered(texts: list[str]) -> defaultdict[str, int]:
    """Text to code; texts that have none get the next one."""
    out = defaultdict(count(len(texts)).__next__)
    out.update(zip(texts, range(len(texts)), strict=True))
    return out


class Lexicon:
    """Pieces of numbers by text, for texts that repeat: one lookup a text, one ragged table.

    ``make`` gives the pieces of new texts as (numbers in a row, how many each). At
    ``limit`` texts those seen only once are forgotten, and of the others the rarer
    ones beyond half the limit.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int, kind: type = np.int32):
        self.make, self.limit = make, limit
        self.codes_of, self.seen = _numbered([]), np.zeros(0, np.int64)
        self.flat, self.size = np.zeros(0, kind), np.zeros(0, np.int64)
        self.start = self.size

    def _shrink(self) -> None:
        often = np.flatnonzero(self.seen > 1)
        kept = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: self.limit // 2]])
        texts = list(self.codes_of)
        flat = self.pieces(kept) if len(self.flat) else self.flat  # counts alone have no numbers
        size, seen = self.size[kept], self.seen[kept] // 2
        self.codes_of = _numbered([texts[k] for k in kept.tolist()])
        self.flat, self.size, self.seen = flat, size, seen
        self.start = np.cumsum(size) - size

    def codes(self, texts: list[str]) -> np.ndarray:
        """The codes of texts; they hold until the next call."""
        if len(self.codes_of) > self.limit:
            self._shrink()
        known = len(self.codes_of)
        out = np.fromiter(map(self.codes_of.__getitem__, texts), np.int64, len(texts))
        if new := list(islice(reversed(self.codes_of), len(self.codes_of) - known)):
            flat, size = self.make(new[::-1])
            self.flat, self.size = np.concatenate((self.flat, flat)).astype(self.flat.dtype), np.concatenate((self.size, size))
            self.start = np.cumsum(self.size) - self.size
            self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int64)))
        self.seen += np.bincount(out, minlength=len(self.seen))
        return out

    def pieces(self, codes: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start, self.size, codes)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` (of the given starts and sizes) that ``codes`` name, one after the other."""
    n = size[codes]
    return flat[np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def sums(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of successive runs of ``values``, of the given lengths."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values)))
    return total[ends] - total[ends - counts]


def words_of(text: str) -> list[str]:
    """Stretches between white space."""
    if _ODD.search(text):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


_WORD = regex.compile(WORD_LEVEL)
_LINES = regex.compile(rf"\p{{L}}+|{BREAK}|{WORD_LEVEL}")  # the same pre-tokens, and breaks
_BYTE = regex.compile(BYTE_LEVEL)


def lower(text: str) -> str:
    """Letter by letter, without the rule for a final sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def _words(text: str) -> list[str]:
    return _WORD.findall(lower(text if text.isascii() else unicodedata.normalize("NFC", text))) if text else []


@lru_cache(1)
def unsure() -> re.Pattern:
    """Characters that Python's Unicode tables don't know: the library's may, so their classes and compositions are left to it."""
    unknown = np.flatnonzero(np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool))
    cuts = np.flatnonzero(np.diff(unknown) > 1)
    runs = zip(unknown[np.r_[0, cuts + 1]].tolist(), unknown[np.r_[cuts, -1]].tolist(), strict=True)
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


def known(text: str) -> bool:
    """Whether Python's tables know all characters of a text. All below U+0378 are known to every version."""
    return text.isascii() or max(text) < "\u0378" or not unsure().search(text)


def word_pieces(v: Vocabulary, word: str) -> list[str | int]:
    """Pre-tokens of a stretch, and ids of special strings in it."""
    if v.find_special.search(word):
        parts = v.find_special.split(word)
        return [p for k, x in enumerate(parts) for p in ([v.special[x]] if k % 2 else word_pieces(v, x))]
    return _words(word) if known(word) else v.library_pieces(word)


def pieces_of_words(v: Vocabulary, words: list[str]) -> list[str | int]:
    """What ``word_pieces`` gives for each of the words, which hold no line ends, behind a BREAK. Most words are split many at once."""
    out = []
    for i in range(0, len(words), TOGETHER):
        some = words[i : i + TOGETHER]
        text = BREAK + BREAK.join(some)
        if v.find_special.search(text) or not known(text):
            out += [p for w in some for p in (BREAK, *word_pieces(v, w))]
        else:
            out += _LINES.findall(lower(text if text.isascii() else unicodedata.normalize("NFC", text)))
    return out


def byte_units(v: Vocabulary, text: str) -> list[str]:
    """Parts of a text at which every byte-level pre-token ends too: the text's words, each with the blank before it."""
    if "  " in text or text.endswith(" ") or any(s in text for s in v.special):
        return [u for p in v.find_special.split(text) if p for u in ([p] if p in v.special else byte_pieces(v, p))]
    head, *rest = text.split(" ")
    return [*([head] if head else []), *(" " + x for x in rest)]


def byte_pieces(v: Vocabulary, unit: str) -> list[str]:
    return _BYTE.findall(unit) if known(unit) else v.library_pieces(unit)
