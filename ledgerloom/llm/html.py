"""Main text of web pages by consensus of their host.

Every page names the container that holds most of its text, and others beside it that hold nearly as much; Spark counts these
votes by host and generalised path (tags with their classes, digits replaced), and each page is then read again through
its host's winning paths. Paths are kept as 64-bit hashes, so that a deeply nested page costs no more than a flat one.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pieces, small, table

#: A path is a winner of its host if it has at least this share of the votes: a host has at most 1 / LEAST paths.
LEAST = 0.1
#: A container beside the best one is voted for if it has this share of its score; a path wins by such votes of HALF of its host's pages.
BESIDE, HALF = 0.4, 0.5
#: A container's score also counts what its children hold, this much less for each step down.
STEP = 0.45
#: Most hosts whose paths are broadcast; beyond it pages and paths are joined by host.
BROADCAST_HOSTS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu svg canvas object audio video map head".split()) | RAW
BLOCKS = frozenset("html body p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre div section article main table caption thead tbody tfoot tr td th figure figcaption hr address details summary center hgroup fieldset".split()) | DROPPED
CONTAINERS = frozenset("html body div section article main td center figure blockquote".split())
WHOLE = frozenset("article main".split())
#: Elements that an element of the key ends, up to the elements after the bar.
CLOSES = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Words of a class, id or role that say what isn't the article: readers' comments, adverts, and the rest.
COMMENTS = frozenset("comment comments commentlist usercomments disqus reply replies respond".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted".split())
OTHERS = frozenset("sidebar breadcrumb breadcrumbs cookie cookies consent gdpr newsletter related recommended recommendations social share sharing".split())
#: A class or role with one of these words marks an element, whatever else it says; ids name sections too, so that of them all words must be known.
ENOUGH = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsored promo promos".split())
STRONG = COMMENTS | ADVERTS | OTHERS
FRAMES = frozenset(["sidebar"])  # words of STRONG that name the frame of a page too
ASIDE = STRONG | frozenset(
    "nav navbar navigation menu submenu masthead header footer notice notices popup modal overlay subscribe subscription signup login "
    "widget widgets toolbar pagination pager skip copyright contentinfo complementary search alert dialog".split()
)
#: Words that say nothing of an element's part in the page.
PLAIN = frozenset(
    "box container wrapper wrap area block section list item items bar panel pane site page post posts entry article articles global main top bottom left right "
    "inner outer primary secondary mobile desktop sticky fixed floating links link buttons button form slot unit media thread reader readers user users visitor "
    "stories story news feed module component row col column grid card cards zone count body text title icon icons more latest popular of the and for your our".split()
)
#: A name with one of these tells how a page is laid out, or what an article is about.
LAYOUT = frozenset("with has no without enabled disabled open closed hoc category tag topic format layout".split())
TITLES = frozenset("header masthead".split())  # inside an article they hold its title
KEPT = frozenset("html body main".split())  # whatever their classes say
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|itemtype)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MASK = (1 << 64) - 1
_DIGITS = re.compile(r"\d+")


def names_aside(value: str, strict: bool = False) -> set[str]:
    """The words of ASIDE for which one of the names in an attribute's value marks its element as no part of the article.

    A name does if all its words are known and one is in ASIDE or, unless strict, if one is in ENOUGH; none does that has a word of LAYOUT.
    """
    found: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name.rpartition("/")[2])}
        if words & LAYOUT:
            continue
        if words <= ASIDE | PLAIN:
            found |= words & ASIDE
        elif not strict:
            found |= words & ENOUGH
    return found


class Page:
    """What parse() finds: blocks (container, text, characters in links), and of each container by number, in the order of
    the page, its parent (-1: none), the hash of its generalised path, and whether it is an article or main element."""

    def __init__(self):
        self.blocks: list[tuple[int, str, int]] = []
        self.parent: list[int] = []
        self.path: list[int] = []
        self.whole: list[bool] = []

    def inside(self, paths: set[int]) -> list[bool]:
        """Whether each container has one of the paths or is in one that has."""
        out: list[bool] = []
        for up, path in zip(self.parent, self.path):
            out.append(path in paths or (up >= 0 and out[up]))
        return out

    def around(self, paths: set[int]) -> list[bool]:
        """Whether each container has one that has one of the paths in it."""
        out = [False] * len(self.path)
        for n in range(len(out) - 1, -1, -1):
            if (out[n] or self.path[n] in paths) and self.parent[n] >= 0:
                out[self.parent[n]] = True
        return out

    def beside(self, chosen: set[int], path: int) -> bool:
        """Whether some container has the path and none that has it is in, or around, one with the chosen paths."""
        inside, around = self.inside(chosen), self.around(chosen)
        at = [n for n, x in enumerate(self.path) if x == path]
        return bool(at) and not any(inside[n] or around[n] for n in at)


def parse(html: str) -> Page:
    """The page's blocks of text outside what never is article text, and its containers."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, container or -1, whether its tag is left out, whether its name is
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    text: list[str] = []
    found: list[tuple[int, str, int, int]] = []  # as blocks, and the innermost element left out by its name (-1: none)
    aside_in: list[int] = []  # the next outer one of each
    frames: list[bool] = []  # whether each may be the page's frame by its name
    holds: list[bool] = []  # whether it holds a main element, or, if it may be a frame, an article
    here, aside = -1, -1
    free = False  # whether an article or main element is in none of them
    out = links = linked = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            if joined := " ".join("".join(text).split()):
                found.append((here, joined, linked, aside))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal out, links, here, aside
        tag, number, left_out, named = stack.pop()
        opened[tag].pop()
        out -= left_out
        links -= tag == "a"
        if tag in BLOCKS or named:
            flush()
        if number >= 0:
            here = page.parent[number]
        if named:
            aside = aside_in[aside]

    def pop_to(tag: str) -> None:
        place = opened[tag][-1]
        while len(stack) > place:
            pop()

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not out:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(piece)

    while at < end:
        m = _TAG.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at, name = m.end(), m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "br":
                say(" ")
            elif tag == "p" and not opened.get("p"):
                flush()
            elif opened.get(tag):
                pop_to(tag)
            continue
        attrs = m[3]
        if m[4] != ">":
            break  # the page ends inside a tag
        if tag == "br" or tag == "wbr":
            say(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if opened.get("p"):
                pop_to("p")
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            place, last = max(((opened[x][-1], x) for x in ends | stop if opened.get(x)), default=(-1, ""))
            if last in ends:
                pop_to(last)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        marks: set[str] = set()
        classes = ids = ""
        if attrs and "=" in attrs:
            for a in _ATTR.finditer(attrs):
                value, which = a[2] or a[3] or a[4] or "", a[1].lower()
                marks |= names_aside(value, which == "id" or tag in WHOLE)
                if which == "class":
                    classes = ".".join(sorted(value.lower().split()))
                elif which == "id":
                    ids = value.lower()
        in_article = bool(opened.get("article"))
        left_out = tag in DROPPED and not (tag == "header" and in_article)
        named = tag not in KEPT and bool(marks - TITLES if in_article else marks)
        if named:
            flush()
            aside_in.append(aside)
            frames.append(not marks & STRONG - FRAMES)
            holds.append(False)
            aside = len(aside_in) - 1
        elif tag in WHOLE and not out:
            free |= aside < 0
            k = aside
            while k >= 0 and not holds[k]:
                holds[k] = tag == "main" or frames[k]
                k = aside_in[k]
        number = -1
        if tag in CONTAINERS:
            number = len(page.path)
            key = f"{tag}.{_DIGITS.sub('#', classes)}" if classes else f"{tag}#{_DIGITS.sub('#', ids)}" if ids else tag
            page.path.append(xxhash.xxh64_intdigest(key, page.path[here] if here >= 0 else 0))
            page.parent.append(here)
            page.whole.append(tag in WHOLE)
            here = number
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, number, left_out, named))
        out += left_out
        links += tag == "a"
    flush()
    # a named element may be the frame of a page that has no article outside such elements
    worth = [0] * len(aside_in)
    for _, block, linked, k in found:
        if k >= 0:
            worth[k] += max(0, len(block) - linked)
    for k in range(len(worth) - 1, -1, -1):
        if aside_in[k] >= 0:
            worth[aside_in[k]] += worth[k]
    most = sum(max(0, len(block) - linked) for _, block, linked, _ in found) / 2
    dropped: list[bool] = []
    for k, up in enumerate(aside_in):
        frame = not free and (holds[k] or (frames[k] and not any(holds) and worth[k] > most))
        dropped.append(not frame or (up >= 0 and dropped[up]))
    kept = [(n, block, linked) for n, block, linked, k in found if k < 0 or not dropped[k]]
    if not kept:  # nothing but what is named so: what may be a frame, or else all
        plain = [(n, block, linked) for n, block, linked, k in found if all(frames[x] for x in _chain(aside_in, k))]
        kept = plain or [(n, block, linked) for n, block, linked, _ in found]
    page.blocks = kept
    return page


def _chain(outer: list[int], k: int):
    """k and all around it."""
    while k >= 0:
        yield k
        k = outer[k]


def best_paths(page: Page) -> list[int]:
    """The path of the container with the highest score: characters outside links of its blocks, and less of those in containers
    below it. Blocks inside an article or a main element count for the outermost of these alone. Behind it come the
    paths of containers beside it with at least BESIDE of its score, none of them in another."""
    size = len(page.path)
    own, whole, score = [0.0] * size, [-1] * size, {}
    for n, text, linked in page.blocks:
        if n >= 0:
            own[n] += max(0, len(text) - linked)
    for n, up in enumerate(page.parent):
        whole[n] = whole[up] if up >= 0 and whole[up] >= 0 else n if page.whole[n] else -1
    for n in range(size - 1, -1, -1):
        at = whole[n] if whole[n] >= 0 else n
        score[page.path[at]] = score.get(page.path[at], 0.0) + own[n]
        if whole[n] < 0 and page.parent[n] >= 0:
            own[page.parent[n]] += own[n] * STEP
    if not page.blocks or not score:
        return []
    order = sorted(score, key=lambda p: (-score[p], p))
    chosen = order[:1]
    for p in order[1:]:
        if score[p] <= 0 or score[p] < BESIDE * score[chosen[0]]:
            break
        if page.beside(set(chosen), p):
            chosen.append(p)
    return chosen


def text_at(page: Page, winners: list[int]) -> str:
    """The blocks below the first of the winning paths that the page has and below those beside it; of a page with none of them those
    below its own best paths."""
    there = set(page.path)
    for paths in (winners, best_paths(page)):
        chosen: set[int] = set()
        for p in paths:
            if p in there and (not chosen or page.beside(chosen, p)):
                chosen.add(p)
        inside = page.inside(chosen) if chosen else []
        if found := [text for n, text, _ in page.blocks if n >= 0 and inside and inside[n]]:
            return "\n\n".join(found)
    return "\n\n".join(text for _, text, _ in page.blocks)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, lower-cased (null or without ://: empty)."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """_host and its winning paths: those that are the best of at least the share `least` of its pages, or among the best of HALF of
    them; those with the most pages first."""

    def vote(batches):
        for batch in pieces(batches):
            hosts, paths, best, nth = batch.column("_host"), [], [], []
            for i, x in enumerate(batch.column("html").to_pylist()):
                found = best_paths(parse(x or ""))
                paths += found
                best += [k == 0 for k in range(len(found))]
                nth += [i] * len(found)
            yield pa.record_batch([hosts.take(pa.array(nth, pa.int64())), pa.array(np.array(paths, np.uint64).view(np.int64)), pa.array(best, pa.bool_())], ["_host", "path", "best"])

    votes = pages.select(host_of(F.col("url")).alias("_host"), "html").mapInArrow(vote, "_host string, path long, best boolean")
    counts = checkpointed(votes.groupBy("_host", "path").agg(F.count_if("best").alias("n"), F.count("*").alias("m")))
    totals = counts.groupBy("_host").agg(F.sum("n").alias("all"))
    winning = counts.join(totals, "_host").where((F.col("n") >= F.col("all") * least) | (F.col("m") >= F.col("all") * HALF))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "path")))  # each page has a few paths: a host has at most 1 / least + a few / HALF
    return winning.groupBy("_host").agg(F.transform(order, lambda x: x["path"]).alias("_paths"))


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of each row (page_id, url, html): the article's blocks joined by two line feeds.

    Left out are scripts, styles, comments of the markup, and elements that are menus, headers, footers, sidebars,
    notices, adverts, forms or reader comments by tag, or by the words of a class, id, role or item type (see names_aside()), however long they are. On a page with
    no article or main element outside of all these, one that isn't named for comments, adverts and the like stays if it holds such an element or most of the page's
    text. A page with nothing else keeps what there is.
    The header inside an article element is part of it. White space inside a block becomes one space;
    character references are decoded; a page that breaks off inside a tag loses that tag alone.

    Null or empty html, and pages without text, give an empty text and 0. Null urls and urls without a host share
    the empty host. Pages with none of their host's paths use their own best container. Rows may repeat; other
    columns are ignored. Pages may have any length and depth.
    """
    winners, _ = small(checkpointed(host_paths(pages, least)), BROADCAST_HOSTS)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host")).join(winners, "_host", "left").select("page_id", "url", "html", "_paths")

    def read(batches):
        for batch in pieces(batches):
            known = ([x & _MASK for x in p or []] for p in batch.column("_paths").to_pylist())
            texts = [text_at(parse(x or ""), p) for x, p in zip(batch.column("html").to_pylist(), known)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))
