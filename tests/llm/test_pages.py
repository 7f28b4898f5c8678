import hashlib
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pastframe.llm import fingerprint, html_extract, url_filter
from pyspark.sql import functions as F

RULES = "verdict string, host string, path string"


def judge(spark, urls, rules=None):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    out = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES if rules is None else rules, RULES))
    return [(r.host, r.path, r.rule, r.verdict) for r in out.orderBy("page_id").collect()]


def test_urls_of_the_contract(spark):
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/", "http://example.com", "http://x.net/fr/#a", "http://net/es/", "ftp://y.org/en/", None, "no scheme", "http://notexample.com/en/", "x://a.net/es?b"]
    assert judge(spark, urls) == [
        ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "", None, "allow"),
        ("x.net", "/fr/", "net/fr/", "block"),
        ("net", "/es/", "net/es/", "block"),
        ("y.org", "/en/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("notexample.com", "/en/", "com/", "allow"),
        ("a.net", "/es", None, "allow"),
    ]


@pytest.mark.parametrize("prefix", [url_filter.PREFIX, 1])
def test_urls_equal_brute_force(spark, monkeypatch, prefix):
    monkeypatch.setattr(url_filter, "PREFIX", prefix)  # a short one lets rules meet that only the whole digest tells apart
    r = random.Random(3)
    part = lambda k: r.choice("ab") * r.randint(1, k)
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((".".join(part(2) for _ in range(r.randint(1, 3))), "/" + part(2) * r.randint(0, 1)) for _ in range(25))}.values())
    urls = ["x://" + ".".join(part(2) for _ in range(r.randint(1, 5))) + "/" + part(3) * r.randint(0, 2) for _ in range(300)]
    for u, (host, path, rule, verdict) in zip(urls, judge(spark, urls, rules), strict=True):
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (rule, verdict) == want, u


def test_urls_against_many_rules_of_many_lengths(spark):
    """Ten thousand rules whose paths have 200 lengths: the plan doesn't grow with them."""
    r = random.Random(6)
    tail = lambda n: "".join(r.choices("ab/", k=n))
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((f"h{r.randint(0, 40)}.net", "/" + tail(r.randint(0, 6)) + "x" * r.randint(0, 200)) for _ in range(10_000))}.values())
    assert len({len(p) for _, _, p in rules}) > 200
    of = {}
    for v, h, p in rules:
        of.setdefault(h, []).append((len(h + p), len(h), v == "block", h + p, v, p))
    urls = [f"x://w.h{r.randint(0, 44)}.net/{tail(r.randint(0, 6))}{'x' * r.randint(0, 220)}" for _ in range(500)]
    for u, (host, path, rule, verdict) in zip(urls, judge(spark, urls, rules), strict=True):
        fits = [f for f in of.get(host.removeprefix("w."), []) if path.startswith(f[5])]
        assert (rule, verdict) == (max(fits)[3:5] if fits else (None, "allow")), u
    size = lambda n: url_filter.judge_urls(spark.createDataFrame([(1, urls[0])], "page_id long, url string"), spark.createDataFrame(rules[:n], RULES))._jdf.queryExecution().optimizedPlan().toString().count("sha2")
    assert size(10_000) == size(5)


def test_urls_of_a_hot_key_and_clashing_names(spark):
    """Half of the rows have no url; the grouped side has an exchange of its own, so the hot key can be split, and the join is on digest prefixes."""
    rows = [(i, None if i % 2 else f"http://h{i}.example.com/en/{i}", i, i, i) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, best long, k long, row long")
    out = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, RULES))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "short" in plan and "(digest" not in "".join(x for x in plan.split("\n") if "Join" in x)
    got = out.collect()
    assert all((r.best, r.verdict) == (r.page_id, "allow" if r.page_id % 2 else "block") for r in got) and len(got) == 400


def test_urls_without_rules_or_rows(spark):
    assert judge(spark, ["http://a.com/"], []) == [("a.com", "/", None, "allow")]
    assert judge(spark, []) == []


PAGE = (
    "<html><head><title>t</title></head><body class='has-sidebar'><header>H</header><div id='cookie-notice'>C</div><nav>N</nav><main><article><h1>T &amp; &#233;</h1>"
    "<p>a<b>b</b> c<p>d <i>e</i></p><form>F</form><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><script>var a='</p>';</script><section class='comments'><p>no</p></section></article>"
    "<aside>S</aside></main><div class='comments'><article class='comment'>R</article></div><footer>f</footer></body></html>"
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "T & é ab c d e x y 1 2"),
        ("just <b>text</b> &lt;x&gt; a < b", "just text <x> a < b"),
        ("<p>un<script>x", "un"),
        ("", ""),
        ("<!-- a --> b &nbsp; c<br>d", "b c d"),
        ("a<!-- x > y", "a"),
        ("<p title='a>b'>q</p></div>r", "q r"),
        ("<article><p>one</p><svg/><p>two</p></article>", "one two"),
        ("<article><p>one</p><noscript>no</article><p>three", "one three"),
        ("<article><p>one</p><svg><path d=x><p>two</p></article>", "one two"),
        ("<head><title>t<body><article>a</article>", "a"),
        ("<article><header><h1>Head</h1></header><p class='header-text'>k</p><div class='search-results'>m</div><div class='notice'>q</div></article>", "Head k m q"),
        ("<article><p>a</p><div class='comment-list'>z</div><div class='ad-slot'>y</div></article><div class='notice'>x</div><h1 class='header'>b</h1>", "a b"),
    ],
)
def test_main_text_of_one_page(page, text):
    assert html_extract.main_text(page) == text


def test_deep_and_broken_pages_in_linear_time():
    start = time.perf_counter()
    assert html_extract.main_text("<div>" * 100_000 + "x") == "x"
    assert html_extract.main_text("<b>" * 100_000 + "x" + "<p>y</b>" * 50_000).count("y") == 50_000
    assert html_extract.main_text("<a " * 200_000 + "<script>" * 50_000) is not None
    assert time.perf_counter() - start < 20


def site(host, n, seed=0):
    """Pages of one template: a list of links, an article of blocks, a sentence that all articles hold, an optional box with one text."""
    r = random.Random(f"{host}{seed}")
    word = lambda: "".join(r.choices("abcdef", k=5))
    for i in range(n):
        kept = [" ".join(word() for _ in range(r.randint(3, 30))) for _ in range(r.randint(2, 6))]
        links = "".join(f"<li><a href='/{j}'>{word()}</a></li>" for j in range(r.randint(2, 6)))
        box = "<p class='by'>Written by our staff</p>" if r.random() < 0.7 else ""
        story = "".join(f"<p>{b}</p>" for b in kept[1:])
        html = f"<html><body><ul class='links'>{links}</ul><div class='story'><h1>{kept[0]}</h1>{box}{story}<p>All rights of {host} are kept.</p></div></body></html>"
        yield f"http://{host}/{i}", html, " ".join(kept)


PAGES = "page_id long, url string, html string, text string"


@pytest.mark.parametrize("small", [html_extract.SMALL, 0])
def test_slots_of_a_template_without_telling_names(spark, small):
    """Texts and link lists of template classes go, by a broadcast and by a shuffle of templates alike."""
    pages = list(enumerate([*site("a.example", 40), *site("b.example", 12)]))
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h, _) in pages], PAGES).repartition(4)
    got = {r.page_id: r.text for r in html_extract.extract_pages(df, small=small).collect()}
    assert all(got[i] == t for i, (_, _, t) in pages)


def unnamed(host, n, share=0.0):
    """Pages whose classes are random letters, all inside one form: links, an advert with a new sentence on each page, at times a notice, an article
    with a constant line and an optional box, a foot of three texts. A ``share`` of the pages holds one and the same article."""
    r = random.Random(host)
    word = lambda: "".join(r.choices("abcdef", k=5))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    bar, ad, note, story, foot, by = ("".join(r.choices("qrstuv", k=9)) for _ in range(6))
    same, feet = [words(9, 60) for _ in range(4)], [words(3, 5) for _ in range(3)]
    for i in range(n):
        kept = same if i < share * n else [words(4, 8), *(words(20, 60) for _ in range(r.randint(2, 6)))]
        links = "".join(f"<div><a href='/{j}'>{word()}</a></div>" for j in range(r.randint(2, 6)))
        notice = f"<div class='{note}'>{words(2, 4)}</div>" if r.random() < 0.4 else ""
        box = f"<p class='{by}'>Written by our staff</p>" if r.random() < 0.7 else ""
        text = "".join(f"<p>{b}</p>" for b in kept[1:])
        top = f"<div class='{bar}'>{links}</div>{notice}<div class='{ad}'>{words(4, 9)}</div>"
        html = f"<html><body><form>{top}<div class='{story}'><h1>{kept[0]}</h1>{box}{text}<p>All of {host} is kept.</p></div><div class='{foot}'>{r.choice(feet)}</div></form></body></html>"
        yield f"http://{host}/{i}", html, " ".join(kept)


class Tree(HTMLParser):
    """Another reading of a well-formed page: elements as tuples of names, and blocks (path, text, linked characters)."""

    def __init__(self, page):
        super().__init__()
        self.open, self.elements, self.found, self.part, self.linked, self.depth = (), [], [], "", 0, 0
        self.feed(page)
        self.flush()

    def flush(self):
        if text := " ".join(self.part.split()):
            self.found.append((tuple(x for x in self.open if x != "a"), text, self.linked))
        self.part, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.flush()
        self.open += (f"{tag}.{dict(attrs)['class']}" if "class" in dict(attrs) else tag,)
        self.elements.append(self.open)

    def handle_endtag(self, tag):
        if tag != "a":
            self.flush()
        self.open = self.open[:-1]

    def handle_data(self, data):
        self.part += data
        self.linked += len(data.strip()) * ("a" in self.open)


def plain_texts(htmls):
    """The same decisions for a host without telling names, over full occurrence vectors and another parser."""
    n, trees = len(htmls), [Tree(h) for h in htmls]
    under = lambda path, top: path[: len(top)] == top
    count = {p: [t.elements.count(p) for t in trees] for p in {p for t in trees for p in t.elements}}
    count = {p: v for p, v in count.items() if sum(map(bool, v)) >= max(3, 0.05 * n)}
    root = {p for p, v in count.items() if v.count(1) >= 0.9 * n}
    sums = lambda top, f: sum(f(b) for t in trees for b in t.found if under(b[0], top))
    every = {}
    for k, t in enumerate(trees):
        for path, text, _ in t.found:
            every.setdefault((path, text), [0] * n)[k] += 1
    chars = {p: sums(p, lambda b: len(b[1])) for p in count}
    links = {p: sums(p, lambda b: b[2]) for p in count}
    again = {p: sums(p, lambda b: len(b[1]) * (sum(map(bool, every[b[:2]])) > 1)) / chars[p] if chars[p] else 0 for p in count}
    fresh = {p: chars[p] - links[p] for p in count}
    slot = lambda p: next((p[:i] for i in range(len(p), 0, -1) if p[:i] in root), ())
    here = ("html",)
    while below := [p for p in root if p != here and slot(p[:-1]) == here]:
        best = max(below, key=fresh.get)
        if fresh[best] < 0.6 * fresh[here]:
            break
        here = best
    titled = {p[:i] for p in count if p[-1] == "h1" for i in range(1, len(p) + 1)}
    while here not in titled:
        here = slot(here[:-1])
    mean = lambda p: chars[p] / sum(map(bool, count[p]))
    page = [sum(len(b[1]) - b[2] for b in t.found) for t in trees]
    held = lambda k: sum(x for x, v in zip(page, every[k], strict=True) if v)
    valid, texts = set(root), [k for k, v in every.items() if v.count(1) >= 0.9 * n]
    if texts and sum(len(k[1]) * sum(every[k]) for k in texts) > 2 / 3 * max(map(held, texts)):
        texts = []
    for v in {tuple(v) for p, v in count.items() if p not in root}:
        tags = [p for p, w in count.items() if tuple(w) == v and p not in root]
        words = [k for k, w in every.items() if tuple(w) == v and sum(map(bool, w)) >= max(3, 0.5 * n)]
        if len({slot(p[:-1]) for p in tags} | {slot(k[0]) for k in words}) == 1:
            valid.update(tags)
            if words and sum(len(k[1]) * sum(v) for k in words) <= 2 / 3 * held(words[0]):
                texts += words
    gone = set()
    for p in valid:
        if chars[p] and not under(p, here) and not under(here, p):
            brief = p not in titled and mean(p) < 0.25 * mean(here)
            if links[p] >= 0.5 * chars[p] or brief or (again[p] >= 0.5 and again[p] >= again[here] + 0.25):
                gone.add(p)
    return [" ".join(x for p, x, _ in t.found if (p, x) not in texts and not any(under(p, g) for g in gone)) for t in trees]


@pytest.mark.parametrize("share", [0.0, 0.6])
def test_texts_of_unnamed_slots_equal_brute_force(spark, share):
    """What goes is told by slots alone, from hosts of many pages to those of three, and copied articles stay whole."""
    hosts = [list(unnamed(h, n, share)) for h, n in (("a.example", 40), ("b.example", 9), ("c.example", 3))]
    want = [t for host in hosts for t in plain_texts([h for _, h, _ in host])]
    pages = [x for host in hosts for x in host]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert [got[i] for i in range(len(pages))] == want
    if not share:  # on three pages a box of two isn't frequent enough
        assert want[:49] == [t for _, _, t in pages[:49]]


@pytest.mark.parametrize("head", ["h1", "h2"])
def test_heading_beside_the_text_is_kept(spark, head):
    """The content slot holds the heading; a heading that all pages share doesn't count, and a form around the page does no harm."""
    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    pages = [(words(4), words(60), words(5)) for _ in range(12)]
    html = "<html><body><form><div class='q'><h2>Latest</h2><p>{2}</p></div><div class='w'><{3} class='t'>{0}</{3}><div class='z'><p>{1}</p></div></div></form></body></html>"
    rows = [(i, f"http://h.example/{i}", html.format(*p, head)) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{t} {x}" for i, (t, x, _) in enumerate(pages))


def test_random_names_leave_texts_alone(spark):
    """Classes and ids replaced by random letters, host by host: hosts of three pages and more keep their texts."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = df.collect()
    host = lambda u: re.sub(r"^[^:]*://([^/?#]*).*$", r"\1", u or "", flags=re.S)
    many = {h for h, c in Counter(host(r.url) for r in rows).items() if c >= 3}
    name = lambda h: lambda m: m[1] + "=\"" + "".join(random.Random(h + m[2]).choices("qxzvk", k=12)) + "\""
    other = [(r.page_id, r.url, re.sub(r'(class|id)="([^"]*)"', name(host(r.url)), r.html or "")) for r in rows]
    a = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    b = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(other, "page_id long, url string, html string")).collect()}
    kept = [r.page_id for r in rows if host(r.url) in many]
    assert len(kept) > 0.8 * len(rows) and all(a[i] == b[i] for i in kept)


def test_named_boxes_in_an_article_need_a_template(spark):
    """A promo box on many pages of a host is no article text; on one page it is, and so is an article that copies share."""
    word = lambda i: f"text{i} " * 9
    rows = [(i, f"http://h/{i}", f"<article><p>{word(i)}</p><div class='promo'>buy {i}</div></article>") for i in range(6)]
    rows += [(10 + i, f"http://g/{i}", f"<article><p>{word(i)}</p></article>" + "<article><div class='promo'>own</div></article>" * (i == 0)) for i in range(40)]
    rows += [(100 + i, f"http://copies/{i}", f"<article><p>{word(1)}</p><p>{word(2)}</p><p>{i}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == word(i).strip() for i in range(6))
    assert got[10] == word(0).strip() + " own"
    assert all(got[100 + i] == f"{word(1)}{word(2)}{i}" for i in range(5))


def test_extract_edges(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>" + "w " * 50_000), (3, "http://a/", "<p>x")]
    rows += [(9, None, f"<p>{i}</p><p>same</p>") for i in range(30)]
    got = sorted((r.page_id, r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 1), (3, 99_999)] and len(got) == 34
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


# --- fingerprints ---------------------------------------------------------------


def plainly(text):
    b, level = text.encode(), []
    for i in range(len(b)):
        w = [b[i - j] if i >= j else 0 for j in range(7)]
        mixed = 0
        for j, x in enumerate(w):
            mixed ^= x << 5 * j & 0xFFFFFFFF
        v = (sum(w) + sum((7 - j) * x for j, x in enumerate(w)) + mixed) % 2**32 + 1
        level.append(-1 if v % 3 else (v & -v).bit_length() - 1)
    k = 0
    while sum(x >= k for x in level) >= 64:
        k += 1

    def letters(h):
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 % 2**64 >> 52
        return chr(fingerprint.LETTERS[h >> 6]) + chr(fingerprint.LETTERS[h & 63])

    def signature(k):
        out, h, p, n = "", 0, 1, 0
        for c, x in zip(b, level, strict=True):
            h, p, n = (h + c * p) % 2**64, p * fingerprint.BASE % 2**64, n + 1
            if x >= k:
                out, h, p, n = out + letters(h), 0, 1, 0
        return out + (letters(h) if n else "")

    return f"{3 << k}:{signature(k)}:{signature(k + 1)}"


def docs(n=40):
    r = random.Random(11)
    return ["".join(r.choices("abcdefgh éß\n", k=r.randint(0, 700))) for _ in range(n)] + ["", "a", "aaaa" * 400, "ab" * 333]


def test_fingerprints_equal_brute_force():
    assert fingerprint.fingerprints(docs()) == [plainly(t) for t in docs()]


def test_likeness():
    t = "".join(random.Random(1).choices("abcdefghijkl ", k=6000))
    u = "".join(random.Random(2).choices("abcdefghijkl ", k=6000))
    f = lambda x: fingerprint.fingerprints([x])[0]
    assert fingerprint.likeness(f(t), f(t)) == 1.0
    assert fingerprint.likeness(f(t), f(t[:3000] + "x" + t[3000:])) > 0.9
    assert 0.35 < fingerprint.likeness(f(t), f(t[:3000] + u[:3000])) < 0.7
    assert fingerprint.likeness(f(t), f(u)) < 0.15
    assert fingerprint.likeness_of("AABBCCDD", "AACCDD") == pytest.approx(6 / 7)


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_edited_texts_over_ranges(spark, parts):
    x = docs(60)
    ids = random.Random(5).sample(range(10_000), len(x))
    rows = [(i, None if t == "a" else t, 1) for i, t in zip(ids, x, strict=True)]
    got = {r.doc_id: r for r in fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), parts=parts).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        f, g, h = fingerprint.fingerprints([t, e, nxt])
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g)
        assert (got[i].near_edited, got[i].near_next) == (fingerprint.likeness(f, g), fingerprint.likeness(f, h))


def test_edited_texts_of_few_rows(spark):
    run = lambda rows: fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert run([]) == []
    assert [r.near_next for r in run([(4, "alone")])] == [1.0]
    assert len(run([(4, "x"), (4, "x"), (None, None)])) == 3
