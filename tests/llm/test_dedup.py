import random
import re
import time
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pastframe.llm import common, exact_dedup, line_dedup, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, lines_total string"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], DOCS)


def corpus(seed, n=250):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(n)]
    texts += [t.upper() for t in texts[:20]] + [t + "\n" for t in texts[20:40]] + texts[40:60] + ["", None, " \t\n", "x" * 30_000]
    for t in texts[60:90]:
        w = (t or "").split()
        if len(w) > 8:
            w[3] = "changed"
            texts.append(" ".join(w))
    return list(enumerate(texts))


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_exact_classes_equal_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: r for r in exact_dedup.dedup_exact(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    assert len(got) == len(rows)
    for g in groups.values():
        keep = min(g)[1]
        for _, i in g:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(g), i == keep)


def test_exact_cuts_long_texts_and_survives_ties(spark):
    long = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz é", k=200_000))
    rows = [(1, long, "s"), (2, long.replace(" ", "  "), "s"), (3, long[:-1], "s"), (3, long[:-1], "s"), (None, "q", "s")]
    got = exact_dedup.dedup_exact(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (3, 3, 2, True)]
    assert exact_dedup.dedup_exact(frame(spark, [])).count() == 0


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрстуфхцчшщыэюя", "aeioutnsrhl", "一丁七万丈三上下不与丐丑专且世丘丙业丛东"])
def test_exact_chunks_of_any_script(spark, letters):
    """No chunk is over 4096 bytes, chunks join to the text, and most outlive an insertion at the front."""
    text = "".join(random.Random(3).choices(letters, k=60_000))
    rows = spark.createDataFrame([(1, text), (2, "+" + text)], "i long, t string").select("i", exact_dedup.chunks(exact_dedup.F.col("t")).alias("c"))
    a, b = (r.c for r in rows.orderBy("i").collect())
    assert "".join(a).encode("latin-1").decode() == text
    assert max(map(len, a)) <= 4096 and len(a) >= 14
    if letters[0] != "a":  # a text without any cut letter is cut by length alone
        assert len(set(a) & set(b)) >= 0.8 * len(a)


def test_exact_ids_at_the_ends_of_long(spark):
    rows = [(-(2**63), "a b", "s"), (2**63 - 1, "a  b", "s"), (None, "ab", "s"), (5, "x y", "s"), (None, "xy ", "s")]
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.dedup_exact(frame(spark, rows)).collect()}
    assert got == {(-(2**63), 2**63 - 1), (2**63 - 1, 2**63 - 1), (None, 2**63 - 1), (5, 5), (None, 5)}


def test_lines_beside_clashing_names(spark):
    names = ["_id", "_gone", "_th", "_h", "gone", "row", "h", "new", "pos", "line"]
    rows = [(i, "same\nown %d" % i, f"s{i}", *range(len(names))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    out = line_dedup.dedup_lines(df, min_sites=3)
    assert out.columns == [*df.columns, "lines_total", "lines_removed"]
    assert [(r.text, r._gone, r.h) for r in out.orderBy("doc_id").collect()] == [("same\nown 0", 1, 6), ("own 1", 1, 6), ("own 2", 1, 6)]


def test_lines_in_linear_time(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(100_000)), f"s{i}") for i in range(3)]
    start = time.perf_counter()
    out = line_dedup.dedup_lines(frame(spark, rows), min_sites=3).select("doc_id", "text", "lines_removed").orderBy("doc_id").collect()
    assert [r.lines_removed for r in out] == [0, 100_000, 100_000] and out[1].text == "" and out[0].text == rows[0][1]
    assert time.perf_counter() - start < 60


def test_lines_by_shuffle_equal_lines_by_broadcast(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choices([f"shared {j}" for j in range(9)], k=5)), f"s{r.randint(0, 9)}") for i in range(60)]
    run = lambda: sorted((x.doc_id, x.text) for x in line_dedup.dedup_lines(frame(spark, rows), min_sites=8).collect())
    want = run()
    monkeypatch.setattr(line_dedup, "FEW", 0)
    assert run() == want


def test_lines_equal_brute_force(spark):
    r = random.Random(7)
    pool = [f"shared line {i}" for i in range(12)] + ["", "  ", "tail "]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 8)) + [f"own {i}"]), f"s{r.randint(0, 9)}" if r.random() < 0.9 else None) for i in range(60)] + [(90, None, "s1"), (91, "", "s1")]
    out = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, rows), min_sites=9).collect()}
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if k := line.strip():
                sites[k].add(s or "")
                first.setdefault(k, (i, p))
    removed = 0
    for i, t, _ in rows:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not (len(sites[x.strip()]) >= 9 and first[x.strip()] != (i, p)))
        assert out[i].text == want and out[i].n_chars == (None if want is None else len(want))
        removed += out[i].lines_removed
    assert removed > 0 and out[90].lines_total == 0 and out[91].lines_total == 1


def test_lines_of_repeated_rows_and_long_texts(spark):
    long = "\n".join(["boiler"] * 3000 + ["end"])
    rows = [(1, long, "a"), (1, long, "a"), (2, "boiler\nx", "b"), (3, "boiler", "c")]
    out = line_dedup.dedup_lines(frame(spark, rows), min_sites=3).orderBy("doc_id").collect()
    assert [x.text for x in out] == ["boiler\nend", "boiler\nend", "x", ""]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def shingles(t, k):
    w = [x for x in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def test_simhash_classes_equal_brute_force(spark):
    rows = corpus(2)
    got = {r.doc_id: r for r in simhash_dedup.simhash_classes(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    prints = {}
    for i, t in rows:
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t, 3)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    sets = Sets(prints)
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    for i in prints:
        assert got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == sets.find(i)


def test_links_of_planted_bits(spark):
    """Pairs at 0 to 4 bits, in tiles of their own and over tile borders."""
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        q = p
        for b in r.sample(range(64), r.randint(1, 4)):
            q ^= 1 << b
        prints.add(q)
    ids = {i: p for i, p in enumerate(sorted(prints))}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in ids.items()]
    nodes = spark.createDataFrame(signed, "id long, f0 long").withColumn("tile", simhash_dedup.quarter_tile("f0"))
    found = simhash_dedup.links(nodes, simhash_dedup.QUARTER_STEPS, 3).collect()
    assert all((ids[e.a] ^ ids[e.b]).bit_count() <= 3 for e in found)
    got, want = Sets(ids), Sets(ids)
    for e in found:
        got.join(e.a, e.b)
    for a in ids:
        for b in ids:
            if a < b and (ids[a] ^ ids[b]).bit_count() <= 3:
                want.join(a, b)
    assert {i: got.find(i) for i in ids} == {i: want.find(i) for i in ids}


def test_near_copies_equal_brute_force(spark):
    rows = corpus(3, 150)
    kept = {r.doc_id for r in simhash_dedup.drop_near_copies(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    sets, s = Sets([i for i, _ in rows]), {i: set(shingles(t, 5)) for i, t in rows}
    for a in s:
        for b in s:
            if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                sets.join(a, b)
    assert kept == {sets.find(i) for i in s}


def near_roots(rows):
    sets, s = Sets([i for i, _ in rows]), {i: set(shingles(t, 5)) for i, t in rows}
    for a in s:
        for b in s:
            if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                sets.join(a, b)
    return {sets.find(i) for i in s}


def kept_of(spark, rows):
    return {r.doc_id for r in simhash_dedup.drop_near_copies(frame(spark, [(i, t, "s") for i, t in rows])).collect()}


def test_near_copies_of_a_dense_group(spark):
    """Several hundred edited copies of one text, most pairs under 0.8."""
    r = random.Random(21)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in r.sample(range(160), r.choice([3, 3, 4, 5])):
            w[p] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
        if i % 40 == 0:  # a true partner at just over 0.8
            for p in (10, 90, 130):
                w[p] = f"y{r.random()}"
            rows.append((1000 + i, " ".join(w)))
    want = near_roots(rows)
    assert 40 < len(want) < len(rows)
    assert kept_of(spark, rows) == want


def test_near_copies_of_nulls_and_nothing(spark):
    rows = [(None, "a b c d e f", "s"), (1, None, "s"), (2, "", "s"), (3, "a b c d e f", "s")]
    out = simhash_dedup.drop_near_copies(frame(spark, rows))
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3] and out.columns == frame(spark, rows).columns
    assert simhash_dedup.drop_near_copies(frame(spark, [])).count() == 0
    assert simhash_dedup.simhash_classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_chains_and_hubs(spark, n):
    chain = [(i, i + 1) for i in range(100, 100 + n)]
    hub = [(7, x) for x in range(500, 500 + n)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 101 + n)} | {i: 7 for i in (7, *range(500, 500 + n))}


def test_components_in_one_round(spark):
    """Links of a task are joined before any shuffle, so chains that fit a task need no rounds of their own."""
    links = [(i + 1, i) for i in range(300)] + [(i, 5000 + i % 7) for i in range(-40, 0)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long").coalesce(1), rounds=1).collect()}
    assert got == {i: 0 for i in range(301)} | {x: r - 40 for r in range(7) for x in (5000 + (r - 40) % 7, *range(r - 40, 0, 7))}


def test_components_of_many_tasks(spark, monkeypatch):
    """Links of one component in many tasks, with copies, ids of both signs and links of a node to itself."""
    monkeypatch.setattr(common, "LINKS", 50)
    r = random.Random(8)
    links = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(250)] + [(-400 + i, -401 + i) for i in range(90)]
    links += links[:60] + [(999, 999)]
    sets = Sets(range(-500, 1000))
    for a, b in links:
        sets.join(a, b)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    assert got == {x: sets.find(x) for a, b in links if a != b for x in (a, b)}


def test_simhash_copies_in_few_jobs(spark):
    """The driver holds something of every job, so both groupings share their checks and components settle in few rounds."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:p] + [f"x{i}"] + base[p + 1 :]), "s") for i, p in enumerate(range(0, 80, 2))]
    spark.sparkContext.setJobGroup("near", "near")
    try:
        assert [x.doc_id for x in corpus_pipeline.distinct(spark, frame(spark, rows), "").collect()] == [0]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    assert jobs <= 220


def test_forest_spans():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50, 400), r.integers(0, 50, 400)
    ok = a != b
    a, b = a[ok], b[ok]
    f = simhash_dedup.forest(50, a, b, r.integers(0, 4, len(a)))
    x, y = Sets(range(50)), Sets(range(50))
    for i, j in zip(a, b, strict=True):
        x.join(i, j)
    for i in f:
        y.join(a[i], b[i])
    assert [x.find(i) for i in range(50)] == [y.find(i) for i in range(50)] and len(f) == 50 - len({x.find(i) for i in range(50)})


def test_near_copies_with_repeats_and_of_few_words(spark):
    """Repeats don't count in sets; 8 and 9 words have 4 and 5 shingles, Jaccard 0.8."""
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    part = words("p", 60)
    rows = [(1, f"{words('h', 44)} {part}"), (2, f"{words('h', 44)} {part} {part} {part}")]
    rows += [(i, words(f"s{i // 2}x", 8 + i % 2)) for i in range(10, 410)]
    want = near_roots(rows)
    assert want == {1, *range(10, 410, 2)}
    assert kept_of(spark, rows) == want


def test_near_copies_of_one_loud_shingle(spark):
    """A shingle of over half of all sets the SimHash alone, but isn't the text."""
    rows = [(1, "ha " * 8 + "red green blue"), (2, "ha " * 8 + "one two three"), (3, "Ha " * 8 + "one two three")]
    assert near_roots(rows) == {1, 2}
    assert kept_of(spark, rows) == {1, 2}


def simhash_roots(rows):
    """Smallest ids of the groups by SimHash class and exact similarity, from all pairs; and of those by exact similarity alone."""
    s, prints = {i: set(shingles(t, 5)) for i, t in rows}, {}
    for i, t in rows:
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(t, 3)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    classes, sets, alone = Sets(s), Sets(s), Sets(s)
    pairs = [(a, b) for a in s for b in s if a < b]
    for a, b in pairs:
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            classes.join(a, b)
    for a, b in pairs:
        both = len(s[a] & s[b]) / len(s[a] | s[b]) if s[a] | s[b] else 1
        if both >= 0.8:
            alone.join(a, b)
        if both >= 0.8 or both >= 0.5 and classes.find(a) == classes.find(b):
            sets.join(a, b)
    return {sets.find(i) for i in s}, {alone.find(i) for i in s}


def test_simhash_copies_equal_brute_force(spark):
    """The pipeline's near dedup goes by SimHash classes, checked, and by exact similarity beyond them."""
    r = random.Random(33)
    texts = [t for _, t in corpus(4, 60)]
    for b in range(12):
        base = [f"b{b}w{i}" for i in range(r.randint(20, 240))]
        for _ in range(14):
            w = list(base)
            for p in r.sample(range(len(w)), r.randint(0, len(w) // 20)):
                w[p] = f"x{r.random()}"
            texts.append(" ".join(w))
        texts.append(" ".join(base + base[:15] * r.randint(1, 6)))  # the same set but for a seam, another fingerprint
    texts += ["ha " * 8 + t for t in ("red green blue", "one two three", "ONE two three", "some more words")]
    rows = list(enumerate(texts))
    want, alone = simhash_roots(rows)
    loud = [i for i, t in rows if (t or "").startswith("ha ha")]
    assert want < alone and {loud[0], loud[1], loud[3]} <= want and loud[2] not in want
    kept = {x.doc_id for x in corpus_pipeline.distinct(spark, frame(spark, [(i, t, "s") for i, t in rows]), "").collect()}
    assert kept == want


def test_simhash_copies_with_equal_sets_and_nulls(spark):
    """Rows of one set but other repeats are one group, texts without words another; rows without an id and repeats of a kept row stay."""
    part = " ".join(f"w{i % 40}" for i in range(400))
    rows = [(5, part, "s"), (3, part + " " + " ".join(f"w{i}" for i in range(40)), "s"), (7, None, "s"), (8, " \n", "s"), (None, part, "s"), (3, part + " " + " ".join(f"w{i}" for i in range(40)), "s")]
    out = corpus_pipeline.distinct(spark, frame(spark, rows), "")
    assert sorted((x.doc_id or 0) for x in out.collect()) == [0, 3, 3, 7] and out.columns == frame(spark, rows).columns
    assert corpus_pipeline.distinct(spark, frame(spark, []), "").count() == 0
