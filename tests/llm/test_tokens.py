import hashlib
import io
import pickle
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pastframe.llm import bpe, common, packing, simhash_dedup, tokens
from pyspark import cloudpickle
from tokenizers import Tokenizer

PIECES = [
    " ", "  ", "\n", "\t", " \n", "a", "the", "The", "'s", "'ll", "1", "23", "½", "é", "e\u0301", "Σ", "ΑΣ", "ß", "İ", "中文", "<|endoftext|>", "<|startoftext|>",
    "<|", "!!", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u2003", "🙂", "aaaa", "ababab", "\u200b", "\x00", "ﬁ", "x" * 30, "%%%", "\u0300",
]


def texts(n=1500):
    r = random.Random(3)
    return ["", "a" * 4000, " " * 90, "ab" * 2000, *("".join(r.choices(PIECES, k=r.randint(0, 12))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    return {f: Tokenizer.from_file(tokens.vocabulary_path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, n_tokens string, ids string")


def test_encode_and_decode_equal_the_library(spark, library):
    x = texts()
    got = {r.doc_id: r for r in tokens.encode_documents(frame(spark, enumerate([*x, None])), tokens.vocabulary_path("byte_bpe_50k.json")).collect()}
    t = library["byte_bpe_50k.json"]
    want = t.encode_batch(x, add_special_tokens=False)
    assert [got[i].ids for i in range(len(x))] == [e.ids for e in want]
    assert [got[i].decoded for i in range(len(x))] == t.decode_batch([e.ids for e in want], skip_special_tokens=False)
    assert got[len(x)].ids == [] and got[len(x)].decoded == ""


def test_every_code_point_is_taken_as_the_library_does(library):
    """All of the planes that have letters, and every 64th beyond; among them characters that Python's Unicode tables don't know."""
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 64)]]
    x = [" ".join(f"{c}a é{c}" for c in chars[i : i + 512]) for i in range(0, len(chars), 512)]
    assert any(bpe.unsure().search(t) for t in x)
    for name in library:
        spec = open(tokens.vocabulary_path(name)).read()
        want = [e.ids for e in library[name].encode_batch_fast(x, add_special_tokens=False)]
        if name.startswith("byte"):
            got = tokens.Coder(spec).encode(x)
        else:
            ids, n = packing.Encoder(spec).encode(x)
            got = np.split(ids, np.cumsum(n)[:-1])
            assert tokens.Counter(spec).count(x).tolist() == [len(w) for w in want]
        assert all(g.tolist() == w for g, w in zip(got, want, strict=True))


def test_digests(spark):
    out = tokens.encode_documents(frame(spark, [(1, "two words")]), tokens.vocabulary_path("byte_bpe_50k.json"))
    r = out.mapInArrow(tokens.digest_ids, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").first()
    ids = np.array(out.first().ids, "<u4")
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(b"two words").hexdigest())


def test_counts_equal_the_library(spark, library):
    x = texts()
    got = {r.doc_id: r for r in tokens.count_tokens(frame(spark, enumerate([*x, None])), tokens.vocabulary_path("word_bpe_49k.json")).collect()}
    want = library["word_bpe_49k.json"].encode_batch(x, add_special_tokens=False)
    assert [got[i].n_tokens for i in range(len(x))] == [len(e.ids) for e in want]
    assert [got[i].n_bytes for i in range(len(x))] == [len(t.encode()) for t in x]
    assert got[len(x)].n_tokens == 0 and not got[len(x)].over_limit
    assert all(got[i].over_limit == (len(e.ids) > 2048) for i, e in enumerate(want))


def test_both_mergers_agree():
    v = bpe.Vocabulary(open(tokens.vocabulary_path("word_bpe_49k.json")).read())
    assert v.ordered
    heap, ranked = bpe.HeapMerger(v), bpe.RankMerger(v)
    r = random.Random(5)
    words = [bytes(r.choices(b"abenrst", k=r.randint(1, 30))) for _ in range(500)]
    last = dict(zip(range(256), v.last.tolist(), strict=True))
    for w, n in zip(words, ranked.counts(words), strict=True):
        assert n == len(merge_plainly(v, [*v.first[list(w[:-1])].tolist(), last[w[-1]]]))
    assert len(heap(b"thethe")) <= 6


def merge_plainly(v, sym):
    rank = {(int(a), int(b)): (i, int(m)) for i, (a, b, m) in enumerate(zip(v.left, v.right, v.made, strict=True))}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(sym, sym[1:])) if p in rank), default=None)
        if best is None:
            return sym
        (_, m), i = best
        sym = [*sym[:i], m, *sym[i + 2 :]]


def test_lexicon_forgets_what_is_rare():
    made = []

    def make(new):
        made.extend(new)
        return np.array([len(x) for x in new for _ in x], np.int32), np.array([len(x) for x in new])

    m = bpe.Lexicon(make, 4)
    for texts in (["a", "bb", "a", "ccc"], ["bb", "dd", "eeeee"], ["a", "ccc"], []):
        assert m.pieces(m.codes(texts)).tolist() == [len(x) for x in texts for _ in x]
    assert made == ["a", "bb", "ccc", "dd", "eeeee", "ccc"]


def test_packing_asks_for_each_distinct_word_once():
    """Before, every word of the texts was looked up in Python and each new one split by a call of its own."""
    e, asked = packing.Encoder(open(tokens.vocabulary_path("word_bpe_49k.json")).read()), []
    e.words.codes = lambda words, codes=e.words.codes: [asked.append(len(words)), codes(words)][1]
    ids, n = e.encode(["the ants  and\nthe\u3000bees ", "the\xa0ants and\u2003the\u2028bees"] * 500)
    assert n.tolist() == [len(ids) // 1000] * 1000 and sum(asked) <= 5  # the, ants, and, bees and what is behind the last blank


def test_words_split_together_are_split_as_alone(monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    v = bpe.Vocabulary(open(tokens.vocabulary_path("word_bpe_49k.json")).read())
    words = sorted({w for t in texts(600) for w in bpe.words_of(t)}) + ["", "ΑΣ", "Don't", "x<|endoftext|>y", "\U000e1000a", "e\u0301\xa0\u0301", "#'s"]
    assert any(v.find_special.search(w) for w in words) and not all(map(bpe.known, words))
    random.Random(4).shuffle(words)
    assert bpe.pieces_of_words(v, words) == [p for w in words for p in (bpe.BREAK, *bpe.word_pieces(v, w))]


def test_parts_are_bounded_and_whole():
    r = random.Random(6)
    rows = [(i, r.choice([None, "", "é" * r.randint(0, 9), "b" * 70])) for i in range(300)]
    batches = [pa.record_batch([pa.array([i for i, _ in x], pa.int64()), pa.array([t for _, t in x], pa.string())], ["doc_id", "text"]) for x in (rows[:7], [], rows[7:])]
    got = [(k.to_pylist(), t.to_pylist()) for k, t in packing.parts(iter(batches), 50)]
    assert [x for k, t in got for x in zip(k, t, strict=True)] == [(i, t or "") for i, t in rows]
    assert all(k and sum(len(x.encode()) for x in t[1:]) <= 50 for k, t in got) and len(got) > 50


def test_pack_is_exact_and_full():
    r = random.Random(2)
    for lengths in ([1], [4096], [9000, 3], [1] * 700, [r.randint(1, 9000) for _ in range(300)], []):
        got = packing.pack(lengths)
        seen = {}
        for size, pieces in got:
            assert sum(n for _, _, n in pieces) == size and size & (size - 1) == 0 and size <= packing.WINDOW
            for d, s, n in pieces:
                seen.setdefault(d, []).append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, m in sorted(seen[d]):
                assert s == at
                at += m
            assert at == n


def test_packing_covers_every_id(spark, library):
    import zlib

    x = {i: t for i, t in enumerate(texts(200))} | {-1: None}
    rows = packing.pack_documents(frame(spark, x.items()).repartition(3), tokens.vocabulary_path("word_bpe_49k.json")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in x.items():
        ids = np.array([*library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.tier == s[0].tier
            at += r.length
        assert at == s[0].tier <= packing.WINDOW


def test_empty_table(spark):
    e = frame(spark, [])
    assert tokens.encode_documents(e, tokens.vocabulary_path("byte_bpe_50k.json")).count() == 0
    assert tokens.count_tokens(e, tokens.vocabulary_path("word_bpe_49k.json")).count() == 0
    assert packing.pack_documents(e, tokens.vocabulary_path("word_bpe_49k.json")).count() == 0


def test_a_block_that_is_packed_keeps_no_texts(spark, monkeypatch):
    """Batches come as Spark sends them, each in one piece of memory; a block of them holds ids, not their texts."""
    kept = []
    monkeypatch.setattr(packing, "mapped", lambda df, run, schema: kept.append(run))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokens.vocabulary_path("word_bpe_49k.json"))
    sink, n, blank = io.BytesIO(), 40, " " * 250_000
    rows = [pa.record_batch([pa.array([k or None], pa.int64()), pa.array(["a" + blank])], ["doc_id", "text"]) for k in range(n)]
    with pa.ipc.new_stream(sink, rows[0].schema) as out:
        for b in rows:
            out.write_batch(b)
    sink.seek(0)
    held = []

    def batches():
        for b in pa.ipc.open_stream(sink):
            held.append(tracemalloc.get_traced_memory()[0])
            yield b

    packing.encoder(open(tokens.vocabulary_path("word_bpe_49k.json")).read()).encode(["a"])
    tracemalloc.start()
    try:
        (packed,) = kept[0](batches())
    finally:
        tracemalloc.stop()
    assert sorted(packed.column(0).to_pylist(), key=lambda x: x or 0) == [None, *range(1, n)]
    assert len(held) == n and held[-1] - held[2] < 10 * len(blank)


def _nothing(batches):
    yield from ()


def test_a_task_forgets_what_its_worker_remembers_for_others():
    """As a worker gets it: pickled. A copy of an operator's memory would be emptied in its place."""
    df = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "1")), mapInArrow=lambda task, _: task)
    task = pickle.loads(cloudpickle.dumps(common.mapped(df, _nothing, "a long")))
    simhash_dedup._words[b"word"]
    assert len(simhash_dedup._words)
    assert list(task(iter(()))) == [] and not simhash_dedup._words
