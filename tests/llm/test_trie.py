import hashlib
import random
import zlib

import pytest
from pastframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, h0 string"


def plain(rows):
    """The trie by nested loops over rebuilt lists."""
    own = {}
    for c, t, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {p: [0, 0] for p in members}
    for p, of in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in kids
            below[p[:d]][1] += (len(of) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted(
        (min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(kids.get(p, [])), *below[p], ends(p)) for p, of in members.items()
    )


def conversations(n, seed, longest=6):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(10 * n), n):
        hot = r.random() < 0.3
        turns = [("user", "hot start")] * hot + [(r.choice(["user", None, ""]), r.choice(["", "a", "bb", "ccc", "ünï", "🙂x", None])) for _ in range(r.randint(0, longest))]
        rows += [(c, None if i == 0 and r.random() < 0.5 else i, role, text, 1, "x") for i, (role, text) in enumerate(turns or [("user", "only")])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "most", "longest"), [(64, 1024, 6), (2, 7, 9), (3, 16, 40), (64, 50, 300)])
def test_equals_nested_loops(spark, length, most, longest):
    rows = conversations(120 if longest < 100 else 30, longest, longest)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), length=length, most=most)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect())) == plain(rows)


def test_equal_conversations_over_shards(spark):
    rows = [(c, t, "user", f"{t}", 0, "x") for c in range(600) for t in range(3)] + [(9_000, t, "user", str(t % 2), 0, "x") for t in range(200)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(8), length=16, most=32)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "nobody", 0, "x"), (7, None, None, None, 0, "x"), (7, None, None, None, 0, "x"), (205, 1, "user", "x" * 300_000, 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df).collect()), key=str) == sorted(plain(rows), key=str)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
