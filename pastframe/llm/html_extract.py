"""Main text of web pages by template deduction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, durable, mapped, table
from .url_filter import split_url

MIN_PAGES = 3  # hosts with fewer pages use the template of all hosts, which has no texts
SUPPORT = 0.9  # a token of the root class stands once on this share of a host's pages
TAG_SHARE, TEXT_SHARE = 0.05, 0.5  # least share of pages for a tag and a text in a class
LINKED, AGAIN, BRIEF, MAJOR = 0.5, 0.5, 0.25, 0.6  # see ``deduce``
MOSTLY = 2 / 3  # texts of a class that fill more than this of their pages are copied articles
SMALL = 2_000_000  # values of all templates together that are broadcast; beyond it pages are shuffled to them
HELD = 1 << 16  # token sums that a task holds before it sends them on

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCRIPTS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style")}
EMPTY = frozenset("script style noscript template textarea iframe svg title".split())
INLINE = frozenset("a abbr b big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
APART = EMPTY | frozenset("head nav footer aside form menu dialog button select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names that label a slot anywhere, and those that label one outside the article, or in it if it belongs to a template class.
STRICT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors comment comments disqus respond reply replies cookie cookies consent gdpr newsletter".split())
LOOSE = frozenset(
    "promo promotion promotions banner notice notices alert alerts sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "copyright share sharing social subscribe subscription signup login popup modal overlay related recommended widget widgets form search toolbar pagination pager skip".split()
)
#: Words after a name that say nothing, and words that make a name speak of something else.
PLAIN = frozenset("list section area box wrapper wrap container block item items inner outer unit slot zone panel group holder bar left right top bottom".split())
ABOUT = frozenset("has have with without no not is are show hide".split())

_ids: dict[tuple[int, str], int] = {}
_looks: dict[tuple[str, str], tuple[str, int]] = {}
REMEMBERED[__name__] = _ids.clear


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


def _child(parent: int, name: str) -> int:
    """Identifier of the path that runs from ``parent`` through ``name``: its size doesn't grow with depth."""
    if (parent, name) not in _ids:
        if len(_ids) > 1 << 18:
            _ids.clear()
        _ids[parent, name] = _hash(f"{parent}/{name}")
    return _ids[parent, name]


def label(tag: str, attr: dict[str, str]) -> int:
    """2: boilerplate wherever it stands; 1: boilerplate outside the article, or in it as part of a template; 0: not labelled.

    What counts is the last telling word of a whole class or id: ``cookie-notice`` and
    ``comments-list`` are labelled, ``header-text``, ``search-results`` and ``has-sidebar`` aren't.
    """
    if "hidden" in attr or attr.get("aria-hidden") == "true" or "display:none" in attr.get("style", "").replace(" ", ""):
        return 2
    if attr.get("role", "").lower() in ROLES:
        return 2
    found = 0
    for name in f"{attr.get('class', '')} {attr.get('id', '')}".split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if ABOUT.isdisjoint(words):
            while words and words[-1] in PLAIN:
                words.pop()
            if words:
                found = max(found, 2 if words[-1] in STRICT or (words[-1] in LOOSE and not STRICT.isdisjoint(words)) else words[-1] in LOOSE)
    return 0 if found == 1 and (tag in HEADINGS or tag in ("article", "main")) else int(found)


def _look(tag: str, raw: str) -> tuple[str, int]:
    """Name of an element in its path, and its label."""
    if not raw.strip():
        return tag, 0
    if (tag, raw) not in _looks:
        if len(_looks) > 1 << 14:
            _looks.clear()
        attr = {k.lower(): (v or "").strip("\"'") for k, v in NAMES.findall(raw)}
        names = attr.get("class", "").split()[:1] or attr.get("id", "").split()[:1]
        name = f"{tag}.{re.sub(r'\d+', '#', names[0].lower())}" if names else tag
        _looks[tag, raw] = name, 0 if tag in ("html", "body") else label(tag, attr)
    return _looks[tag, raw]


def blocks(
    page: str, spine: frozenset[int] = frozenset(), gone: frozenset[int] = frozenset(), content: int | None = None, tags: dict[int, list] | None = None
) -> list[tuple[int, str]]:
    """(path, text) of each block of a page that neither a template nor a label sets apart, in order.

    ``spine``: paths from the root to the content slot ``content``, where labels don't
    count. ``gone``: paths that the template sets apart. With ``tags`` no label sets
    anything apart (only elements without text do), and ``tags`` collects per path how
    often it stands, its first place, its parent, name, label, and the characters and
    linked characters in it. Closing tags that authors may leave out are supplied,
    stray ones ignored; an element that never closes ends with its parent. Time and
    memory are linear in the page, however deep it nests.
    """
    out: list[tuple[int, str]] = []
    part: list[str] = []
    # Per open element: tag, path, set apart, in the article, path of the block it is in, blocks up to it.
    stack: list[tuple[str, int, bool, bool, int, int]] = [("", 0, False, False, 0, 0)]
    where: dict[str, list[int]] = defaultdict(list)
    endless: set[str] = set()
    at, n, last, place, linked = 0, len(page), page.rfind(">") + 1, 0, 0

    def flush() -> None:
        nonlocal linked
        if part:
            if words := " ".join("".join(part).split()):
                home = stack[-1][4]
                out.append((home, words))
                if tags is not None and home in tags:
                    tags[home][5] += len(words)
                    tags[home][6] += min(linked, len(words))
            part.clear()
        linked = 0

    def cut(to: int) -> None:
        while len(stack) > to:
            where[stack.pop()[0]].pop()

    while True:
        m = TAG.search(page, at, last) if at < last else None
        end = m.start() if m else n
        if end > at and not stack[-1][2]:
            part.append(entities.unescape(page[at:end]))
            if where["a"]:
                linked += len(part[-1].strip())
        if not m:
            break
        at = m.end()
        tag, raw = m[1] or m[4], m[2] or m[5] or ""
        if not tag:
            if page.startswith("<!--", end) and not page.startswith("-->", at - 3):
                break
            continue
        tag = tag.lower()
        if page[end + 1] == "/":
            if where[tag]:
                to = where[tag][-1]
                if tag in INLINE and stack[-1][5] > stack[to][5]:
                    continue
                if stack[-1][5] > stack[to - 1][5]:
                    flush()
                cut(to)
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            for t in ("svg", "title", "head", "p"):
                if where[t]:
                    cut(where[t][-1])
        if over := CLOSES.get(tag):
            while stack[-1][0] in over:
                cut(len(stack) - 1)
        name, lab = _look(tag, raw)
        _, up, apart, inside, home, deep = stack[-1]
        path = _child(up, name)
        if tags is not None:
            place += 1
            if path in tags:
                tags[path][0] += 1
            else:
                tags[path] = [1, place, up, name, lab, 0, 0]
        if tag in VOID or (tag in EMPTY and raw.endswith("/")):
            continue
        if tag in SCRIPTS and tag not in endless:
            if done := SCRIPTS[tag].search(page, at):
                at = done.end()
                continue
            endless.add(tag)
        if tags is not None:
            apart = apart or tag in EMPTY or tag == "head"
        elif path not in spine:
            apart = apart or path in gone or tag in APART or lab == 2 or (not inside and (lab == 1 or tag == "header"))
        where[tag].append(len(stack))
        block = tag in BLOCK
        stack.append((tag, path, apart, inside or path == content or tag == "article" or tag == "main", path if block else home, deep + block))
    flush()
    if tags is not None:
        for _, _, up, _, _, chars, links in reversed(tags.values()):
            if up in tags:
                tags[up][5] += chars
                tags[up][6] += links
    return out


def text_token(path: int, text: str) -> int:
    """A text token: a whole block at its path."""
    return _hash(text, path & 0xFFFFFFFFFFFFFFFF)


def main_text(page: str, spine: list[int] | None = None, gone: frozenset[int] = frozenset(), texts: frozenset[int] = frozenset()) -> str:
    """What the content slots of the template hold, but for template texts; ``spine`` starts at the content slot."""
    found = blocks(page, frozenset(spine or ()), gone, spine[0] if spine else None)
    return " ".join(t for p, t in found if not texts or text_token(p, t) not in texts)


PRIME = (1 << 61) - 1
_SUMS = "site long, token long, parent long, name string, kind int, pages long, once long, times long, vector long, place long, chars long, links long, held long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per (site, token); the vector is the sum of count times page hash, which stands for the token's occurrences on all pages."""
    names = [f.split()[0] for f in _SUMS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 8]
    sums: dict[tuple, list] = {}

    def add(key: tuple, first: tuple, n: int, h: int, place: int, chars: int, links: int, held: int) -> None:
        s = sums.get(key)
        if s is None:
            s = sums[key] = [*first, 0, 0, 0, 0, 0, 0, 0, 0]
        s[3] += 1
        s[4] += n == 1
        s[5] += n
        s[6] = (s[6] + n * h) % PRIME
        s[7] += place
        s[8] += chars
        s[9] += links
        s[10] += held

    def sent() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for b in batches:
        for site, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            page = page.as_py()
            h, tags, words, size = xxhash.xxh64_intdigest(page) % PRIME, {}, defaultdict(int), {}
            for path, text in blocks(page, tags=tags):
                words[path, text_token(path, text)] += 1
                size[path, text_token(path, text)] = len(text)
            held = sum(v[5] - v[6] for v in tags.values() if v[2] not in tags)
            for token, (n, place, up, name, kind, chars, links) in tags.items():
                add((site, token), (up, name, kind), n, h, place, chars, links, held)
                add((None, token), (up, name, kind), n, h, place, chars, links, held)
            for (path, token), n in words.items():
                add((site, token), (path, None, None), n, h, 0, n * size[path, token], 0, held)
            if len(sums) > HELD:
                yield sent()
    if sums:
        yield sent()


def deduce(tokens: pd.DataFrame) -> tuple[str, list[int], list[int], list[int]] | None:
    """Template of one host: its description, the path up from its content slot, the paths set apart, the template texts.

    ``tokens`` has a row per frequent token with sums over the host's ``n`` pages.
    Tokens of one occurrence vector are one class. The root class stands once on nearly
    all pages. Another class is valid if all its tokens nest in one slot, that is, have
    the same innermost root element. What the pages put into a slot tells what it is:

    - The content slot: from the outermost element down to the root element that holds
      MAJOR of the unlinked characters, up to the first ``article`` or ``main``, and back
      up until it holds the pages' one ``h1`` (else ``h2``) that isn't the same on page after
      page. Body itself is none.
    - Elements beside it, of the root or a valid class, go if LINKED of their characters
      are links, if AGAIN of them repeat on other pages (and clearly more than the
      content does), or if they hold less than BRIEF of the content's characters a page
      and no such heading. What is long and fresh stays undecided: there its name settles it.
    - In the content, loosely named elements of the root or a valid class go, and so do
      texts of the root class, and those of a valid class of tags and texts on half of the
      pages, unless they fill MOSTLY all of the pages that they are on.
    - A list outside the content whose items and links share a vector is a menu.
    """
    n = int(tokens.n.iloc[0])
    tag, text = tokens[tokens.name.notna()], tokens[tokens.name.isna()]
    root = {int(t) for t in tag.token[tag.once >= SUPPORT * n]}
    if not root:
        return None
    col = {c: dict(zip(tag.token.tolist(), tag[c].tolist(), strict=True)) for c in ("parent", "name", "kind", "place", "vector", "chars", "links", "pages", "said", "again")}
    up, name, chars, links, pages = (col[c] for c in ("parent", "name", "chars", "links", "pages"))
    element = {t: x.split(".")[0] for t, x in name.items()}

    def above(path: int, stop) -> list[int]:
        """The path and its elements above, up to the first that ``stop`` holds."""
        run = []
        while path in up:
            run.append(path)
            if path in stop:
                break
            path = up[path]
        return run

    slots: dict[int, int] = {}

    def slot(path: int) -> int:
        run = []
        while path in up and path not in root and path not in slots:
            run.append(path)
            path = up[path]
        found = slots.get(path, path)
        slots.update(dict.fromkeys(run, found))
        return found

    # Characters of whole subtrees that were counted per text, and those of them on two pages or more.
    depth: dict[int, int] = {0: 0}
    for t in sorted(up, key=lambda t: col["place"][t]):
        run = above(t, depth)
        start = depth.get(run[-1], 0) if run[-1] in depth else 0
        for i, x in enumerate(reversed(run)):
            depth.setdefault(x, start + i + 1)
    said, again = dict(col["said"]), dict(col["again"])
    titled = {t for t in up if element[t] == "h1"}
    for t in sorted(up, key=lambda t: -depth[t]):
        if up[t] in said:
            said[up[t]] += said[t]
            again[up[t]] += again[t]
        if t in titled:
            titled.add(up[t])

    def fresh(t: int) -> int:
        return chars[t] - links[t]

    def repeats(t: int) -> float:
        return again[t] / said[t] if said[t] else 0.0

    below = defaultdict(list)
    for t in root:
        if element[t] != "head":
            below[slot(up[t])].append(t)
    here = max((t for t in root if slot(up[t]) not in root), key=lambda t: (fresh(t), -t))
    while element[here] not in ("article", "main") and below[here]:
        best = max(below[here], key=lambda t: (fresh(t), -t))
        if fresh(best) <= 0 or fresh(best) < MAJOR * fresh(here):
            break
        here = best
    usual = max(AGAIN, repeats(here) + AGAIN / 2)
    heads = next(filter(None, ([t for t in root if element[t] == h and repeats(t) < usual] for h in ("h1", "h2"))), [])
    above_heads = {x for t in heads for x in above(t, ())}
    titled |= above_heads
    if heads:
        while here not in above_heads and slot(up.get(here, 0)) in root:
            here = slot(up[here])
    spine = above(here, ()) if element[here] not in ("html", "body") else []
    around, content = set(spine), spine[0] if spine else None
    within: dict[int, bool] = {}

    def inside(path: int) -> bool:
        run = above(path, within)
        if run:
            got = within.get(run[-1], False)
            for x in reversed(run):
                got = within[x] = got or x == content or element[x] in ("article", "main")
            return got
        return False

    classes = defaultdict(lambda: ([], []))
    for t, v in col["vector"].items():
        if t not in root:
            classes[v][0].append(t)
    rows = list(zip(*(text[c].tolist() for c in ("token", "parent", "vector", "pages", "once", "chars", "held")), strict=True))
    for t, p, v, on, *_, size, held in rows:
        if on >= TEXT_SHARE * n:
            classes[v][1].append((t, p, size, held))
    often = [(t, size, held) for t, *_, once, size, held in rows if once >= SUPPORT * n]
    texts = [t for t, *_ in often] if sum(size for _, size, _ in often) <= MOSTLY * max((held for *_, held in often), default=0) else []
    valid, nested = set(root), defaultdict(list)
    for tags, words in classes.values():
        if tags and len({slot(up[t]) for t in tags} | {slot(p) for _, p, *_ in words}) == 1:
            nested[slot(up[tags[0]])].append(" ".join(sorted(name[t] for t in tags)) + f" + {len(words)} texts" * bool(words))
            valid.update(tags)
            if words and sum(w[2] for w in words) <= MOSTLY * words[0][3]:
                texts += [w[0] for w in words]
    gone = {t for t in valid if col["kind"][t] == 1 and inside(t) and t not in around}
    for t in valid - around:
        if chars[t] and not inside(t) and element[t] not in ("html", "body") and (spine or t not in titled):
            brief = spine and t not in titled and chars[t] / pages[t] < BRIEF * chars[content] / pages[content]
            same = spine and repeats(t) >= AGAIN and repeats(t) >= repeats(content) + AGAIN / 2
            if links[t] >= LINKED * chars[t] or brief or same:
                gone.add(t)
    many = tag[tag.times >= 2 * tag.pages].token.tolist()
    for t in many:
        if element[t] == "a" and not inside(t) and element.get(up[t]) == "li" and col["vector"][t] == col["vector"][up[t]] and up[up[t]] in up:
            gone.add(up[up[t]])
    gone -= around
    lines = [
        f"{name[t]}{' (content)' if t == content else ' (apart)' if t in gone else ''}: {'; '.join(sorted(nested[t])) or '-'}"
        for t in sorted(root, key=lambda t: (col["place"][t], t))
    ]
    return "\n".join(lines), spine, sorted(gone), sorted(set(texts))


def templates(pages: DataFrame) -> DataFrame:
    """site (hash of the host; null: all hosts), template, spine, gone, texts. ``pages``: site, html.

    Token sums are combined in the tasks and before the shuffle, so a host with a third of
    all pages is spread by its tokens; one task of ``deduce`` sees the tokens of one host
    that stand on a share of its pages, at most 20 times the tokens of a page. Which
    characters of a place repeat is summed over all of its texts, rare ones too.
    """
    full = pages.where("html <> ''")
    per = durable(mapped(full.select("site", "html"), _count, _SUMS).groupBy("site", "token").agg(
        *[F.first(c).alias(c) for c in ("parent", "name", "kind")],
        *[F.sum(c).alias(c) for c in ("pages", "once", "times", "chars", "links", "held")],
        F.expr(f"cast(sum(cast(vector as decimal(38,0))) % {PRIME} as long)").alias("vector"),
        (F.sum(F.col("place").cast("decimal(38,0)")).cast("double") / F.sum("pages")).alias("place"),
    ))
    told = per.where("name is null").groupBy("site", "parent").agg(F.sum("chars").alias("said"), F.sum(F.when(F.col("pages") >= 2, F.col("chars")).otherwise(0)).alias("again"))
    told = told.union(told.groupBy("parent").agg(F.sum("said"), F.sum("again")).select(F.lit(None).cast("long"), "*"))
    told = told.select(F.col("site").alias("_site"), F.col("parent").alias("_path"), "said", "again")
    per = per.where(F.col("pages") >= MIN_PAGES)
    size = full.groupBy("site").agg(F.count("*").alias("n"))
    size = size.union(size.select(F.lit(None).cast("long"), F.sum("n"))).where(F.col("n") >= MIN_PAGES).select(F.col("site").alias("_site"), "n")
    share = F.when(F.col("name").isNull(), TEXT_SHARE).otherwise(TAG_SHARE)
    often = per.join(size, per.site.eqNullSafe(size._site)).where(F.col("pages") >= share * F.col("n")).drop("_site")
    often = often.join(told, often.site.eqNullSafe(told._site) & (often.token == told._path) & often.name.isNotNull(), "left").drop("_site", "_path").fillna(0, ["said", "again"])

    def run(tokens: pd.DataFrame) -> pd.DataFrame:
        site, got = tokens.site.iloc[0], deduce(tokens)
        rows = [(None if pd.isna(site) else int(site), *got)] if got else []
        return pd.DataFrame(rows, columns=["site", "template", "spine", "gone", "texts"]).astype({"site": "Int64"})

    return often.groupBy("site").applyInPandas(run, "site long, template string, spine array<long>, gone array<long>, texts array<long>")


def _extract(default: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            texts = []
            for i, (site, page) in enumerate(zip(b.column(3).to_pylist(), b.column(2), strict=True)):
                if site not in held:
                    if len(held) > 10_000:
                        held.clear()
                    own = [b.column(k)[i].as_py() for k in (4, 5, 6)] if b.column(4)[i].is_valid else default
                    held[site] = own[0], frozenset(own[1]), frozenset(own[2])
                texts.append(main_text(page.as_py() or "", *held[site]))
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", small: int = SMALL) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Tag tokens are paths of elements, text tokens whole blocks. ``deduce`` groups a
    host's tokens by occurrence vector into classes, nests the valid ones into a template
    and judges its slots by what all pages put into them: prose, links, repeated or brief
    texts. Each page keeps what the content slots hold. Names of elements settle only
    what that leaves open. Hosts of fewer than 3 pages, or whose pages share no template,
    use the slots of all hosts together and no template texts. Templates that hold ``small`` values or fewer together are
    broadcast; beyond it pages and templates are shuffled by host, salted.

    Null and empty html give an empty text; null urls are one host of their own;
    repeated rows repeat; an empty table gives an empty result; further columns are
    ignored.
    """
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(split_url(F.col(url))[0]).alias("site"))
    found = durable(templates(src.select("site", "html")).drop("template"))
    default = found.where("site is null").first()
    found = found.where("site is not null")
    values = found.agg(F.sum(F.size("spine") + F.size("gone") + F.size("texts") + 4)).first()[0]
    if (values or 0) <= small:
        joined = src.join(F.broadcast(found), "site", "left")
    else:
        salts = 64
        many = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(many, ["site", "salt"], "left")
    rest = (default.spine, default.gone, []) if default else ([], [], [])
    return mapped(joined.select("page_id", "url", "html", "site", "spine", "gone", "texts"), _extract(rest), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
