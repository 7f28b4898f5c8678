import random

import numpy as np
from pastframe.llm import quality

SCHEMA = "doc_id long, text string, votes string, kept string"


def prose(r, n):
    w = ["".join(r.choices("aeinorst", k=r.randint(2, 9))) for _ in range(400)]
    return ". ".join(" ".join(r.choices(w, k=r.randint(4, 12))).capitalize() for _ in range(n)) + "."


def corpus():
    r = random.Random(1)
    good = [prose(r, r.randint(8, 30)) for _ in range(300)]
    spoil = [lambda t: " ".join(w + "###" for w in t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(t.split()[:2] * 80), lambda t: t.replace(" ", " | ")]
    bad = [spoil[i % 4](prose(r, 15)) for i in range(60)]
    return good, bad


def test_junk_goes_and_good_stays(spark):
    good, bad = corpus()
    rows = [(i, t, "x", "x") for i, t in enumerate([*good, *bad, None, "", "Short."])]
    got = {r.doc_id: r for r in quality.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(good)
    assert all(got[i].kept for i in range(n))
    assert sum(not got[i].kept for i in range(n, n + 60)) >= 57
    assert got[n + 60].votes == "-" * len(quality.LABELLERS) and got[n + 60].kept and got[n + 61].kept


def test_filter_keeps_rows_whole(spark):
    good, bad = corpus()
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate([*good, *bad])], SCHEMA)
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} >= set(range(len(good)))


def test_clean_corpus_and_empty_table(spark):
    good, _ = corpus()
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(good)], SCHEMA)
    assert quality.keep_good(df).count() == len(good)
    assert quality.keep_good(df.limit(0)).count() == 0 and quality.score_documents(df.limit(0)).count() == 0


def simulated(n=6_000):
    """Votes of texts of four kinds of junk, each seen by two labellers or more, and of good texts that each labeller misjudges at its own rate."""
    r = np.random.default_rng(1)
    k = len(quality.LABELLERS)
    sees = np.zeros((4, k))
    for i, who in enumerate([(0, 6), (1, 3, 5), (2, 3, 7), (0, 4, 6)]):
        sees[i, list(who)] = 0.9
    wrong = np.linspace(0.002, 0.03, k)
    kind = np.where(r.random(n) < 0.2, r.integers(0, 4, n), -1)
    junk = r.random((n, k)) < np.where((kind >= 0)[:, None], np.maximum(sees[kind], 0.02), wrong)
    seen = r.random((n, k)) < 0.9
    keys = ["".join("-" if not s else "j" if j else "g" for s, j in zip(a, b, strict=True)) for a, b in zip(seen, junk, strict=True)]
    return keys, kind >= 0, wrong


def test_estimates_recover_rates():
    keys, bad, wrong = simulated()
    post, rates, share = quality.estimate({x: keys.count(x) for x in set(keys)})
    assert abs(share - bad.mean()) < 0.03
    assert np.abs(rates[:, 1] - wrong).max() < 0.02 and (rates[:, 0] > 0.1).all()
    assert np.mean([(post[x] > 0.5) == y for x, y in zip(keys, bad, strict=True)]) > 0.93
    assert quality.estimate({})[0] == {}


def test_estimates_equal_brute_force_over_rows():
    """Each row on its own, in plain loops, a fixed number of rounds."""
    keys = simulated(400)[0]
    k, n = len(quality.LABELLERS), len(keys)
    rates = [[quality.START[0]] * k] + [[quality.START[i == j] for j in range(k)] for i in range(k)]
    first = weight = [0.9] + [0.1 / k] * k
    for _ in range(25):
        post = []
        for row in keys:
            p = []
            for c in range(k + 1):
                x = weight[c]
                for j, vote in enumerate(row):
                    x *= {"j": rates[c][j], "g": 1 - rates[c][j], "-": 1.0}[vote]
                p.append(x)
            post.append([x / sum(p) for x in p])
        weight = [(sum(p[c] for p in post) + first[c]) / (n + 1) for c in range(k + 1)]
        total = lambda c, j, letters: sum(p[c] for p, row in zip(post, keys, strict=True) if row[j] in letters)
        rates = [[(total(c, j, "j") + 1) / (total(c, j, "gj") + 2) for j in range(k)] for c in range(k + 1)]
    got, own, share = quality.estimate({x: keys.count(x) for x in set(keys)}, rounds=25)
    assert all(abs(got[x] - (1 - p[0])) < 1e-9 for x, p in zip(keys, post, strict=True))
    assert np.allclose(own[:, 1], rates[0]) and abs(share - (1 - weight[0])) < 1e-9


def test_estimates_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    *_, rates = quality.fit(docs)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    voted = [(quality.votes(*quality.statistics(r.text or "")), r.quality) for r in rows]
    for j in range(len(quality.LABELLERS)):
        for kind, est in ((0, rates[j, 0]), (1, rates[j, 1])):
            seen = [v[j] == "j" for v, q in voted if q == kind and v[j] != "-"]
            assert abs(np.mean(seen) - est) < 0.12


def test_copies_of_one_text_do_not_drown_the_sample(spark):
    good, bad = corpus()
    rows = [(i, t, "x", "x") for i, t in enumerate([*good, *bad])] + [(1000 + i, good[0], "x", "x") for i in range(4000)] + [(7, good[1], "x", "x")] * 2000
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA), sample=400).collect()}
    n = len(good)
    assert kept >= set(range(1000, 5000)) and len(kept & set(range(n))) >= 0.97 * n
    assert len(kept & set(range(n, n + 60))) <= 12


def test_statistics_of_odd_texts():
    assert quality.statistics("") == (0, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0])
    n, s = quality.statistics("a a a | b!")
    assert n == 5 and s[2] == 0.4 and s[4] == 0.2 and s[5] == 0.2 and s[6] == 0.2 and s[7] == 0.2
    assert quality.statistics("a# b## #")[1][6] == 1.0
    assert sum(map(len, quality.hashed("x" * (quality.CHARS + 100)))) == quality.CHARS + 98 and not list(quality.hashed("é"))
