"""Main text of pages: the roles of elements, and the repeated substrings of a host's suffix array.

A page is cut into blocks, each with the role its elements give it: chrome (menus, headers, footers,
sidebars, notices, adverts, forms, comments), article (inside ``article`` or ``main``) or other.  Chrome
goes.  What is left is judged against the other pages of its host: the blocks' tokens, page after page, make
one stream; its suffixes are sorted, and neighbours that share a long prefix are a repeated substring.
A substring counts if it has ``DEPTH`` tokens or is a whole block, and if it is on over a share of the host's
pages: ``COMMON_SHARE`` and ``COMMON_PAGES`` at least to go from articles, which may share passages, and
``OTHER_SHARE`` and two pages at least to go from other blocks.  Runs are held as text, never as hashes.  The tokens
that they cover go; what is unique stays.  A page of which nothing unique would remain is a copy, and keeps
its blocks.

Pages of a host whose text is equal, or that share most of it, are one group and count once: a group
is judged by one page.  Equal texts meet by a hash; near copies by bands of a min-hash sketch of the
token windows, each held against the first page of its band, so a group of G pages costs G rows.

The pages of a host are dealt into groups of about ``GROUP``, and each group has a suffix array of its own, so no
task holds a host.  A substring on over a share of all pages is on over that share of some group's, so the
groups find every one; where a host has several groups, the pages that hold each are then counted exactly, by
pre-aggregation, a window of ``DEPTH`` tokens at a time: a run is covered by its windows, and is as common as
they are.

Defined results: null or empty html gives the empty text; a null url is the host ''; very long pages are taken
whole, in time linear in their markup however broken; repeated rows give the same text and count as one page;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.common import connected_components, drop, free_shuffles, only, stage
from needlework.llm.url_filter import host_and_path
from needlework.operators.repeats import lcp_intervals, suffix_order
from needlework.plans.layout import spread

#: Tokens of a repeated substring at least, unless it is a whole block.
DEPTH = 8
#: Over what share of a host's pages, and on how many at least, a run of an article, or of another block, is boilerplate.
COMMON_SHARE, COMMON_PAGES = 0.5, 5
OTHER_SHARE, OTHER_PAGES = 0.2, 2
#: Pages of a host that share a suffix array.
GROUP = 64
#: Places of a page's sketch, those of a band, and how many must agree for near copies: 0.55 of the windows in either.
SKETCH, BAND = 64, 4
AGREE = 36

CHROME, ARTICLE, OTHER = 0, 1, 2

#: Possessive throughout: what does not match is never tried again, so broken markup costs its length.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^>\"']*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HUMP = re.compile(r"([a-z])([A-Z])")
_NAME = re.compile(r"[a-z]+|\d+")
#: What a name says of a container's surroundings, not of itself.
_ABOUT = re.compile(r"\b(?:with|has|no|without|hide|show)[-_ ][a-z]+")

#: Elements whose content is text to no reader.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr", "img", "source", "track", "embed", "input", "meta", "link", "area", "param", "base",
}
CHROME_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "svg", "canvas", "object", "audio", "video", "map", "datalist", "fieldset"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of class or id names.
CHROME_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer", "masthead", "topbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal",
    "overlay", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "related", "recommended", "share", "sharing",
    "social", "widget", "widgets", "pagination", "pager", "toolbar", "copyright", "disclaimer", "paywall", "alert",
}
CHROME_ENDS = ("nav", "menu", "footer", "sidebar", "comments", "banner", "popup", "navbar")
CHROME_STARTS = ("advert", "cookie", "sidebar", "sponsor", "breadcrumb", "newsletter")
#: These are chrome outside an article only; an article's header holds its headline.
OUTER_NAMES = {"header"}
#: A header of these holds a headline, a sidebar after these is part of a layout's name, and topics are not roles.
HEADED = {"entry", "post", "article", "story", "content"}
LAYOUTS = {"content", "layout", "page", "template", "columns", "column", "col", "main"}
TOPICS = {"category", "tag", "term", "topic", "author", "cat"}
SIDEBARS = {"sidebar", "sidebars"}
#: Words that leave a name's role as it is.
PLAIN = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "desktop", "div", "fixed", "form", "global", "group",
    "header", "icons", "id", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "post", "primary", "right",
    "row", "secondary", "section", "site", "slot", "sticky", "text", "title", "top", "unit", "view", "wrap", "wrapper", "zone",
}
#: Elements whose names are their own slugs, or that hold a page's text.
NAMELESS = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Inside an article only these are chrome by a name, and only if all of it says so; its ids are often slugs, so of them only these words do.
CONTAINERS = {"div", "section", "ul", "ol", "p", "span"}
INNER_IDS = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "commentlist", "disqus", "respond", "newsletter", "cookie", "cookies"}
#: End tags inside these do not reach what is outside, but for those of the second kind.
FENCES = {"article", "main", "body", "td", "th"}
OVER_FENCES = {"article", "main", "body", "html", "table", "tr", "section", "div"}
#: Opening one of these ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}


def _named(word: str) -> bool:
    return word in CHROME_NAMES or word.endswith(CHROME_ENDS) or word.startswith(CHROME_STARTS)


def _is_role(token: str, whole: bool, inside: bool) -> bool:
    """Whether a class or id names a part of a page's chrome: in its first or last telling word, or (whole) in all of them."""
    for form in {token.lower(), _HUMP.sub(r"\1 \2", token).lower()}:
        words = _NAME.findall(_ABOUT.sub("", form))
        if not words or words[0] in TOPICS and len(words) > 1:
            continue
        if not inside and words[-1] in OUTER_NAMES and not HEADED & set(words):
            return True
        telling = [w for w in words if not w.isdigit() and (w not in PLAIN or _named(w))]
        if not telling or not (all(map(_named, telling)) if whole else _named(telling[0]) or _named(telling[-1])):
            continue
        at = next((i for i, w in enumerate(words) if w in SIDEBARS), 0)
        if LAYOUTS & set(words[:at]) and not any(_named(w) for w in words if w not in SIDEBARS):
            continue
        return True
    return False


#: How an element is chrome: by its name alone, or by its kind.
BY_NAME, BY_KIND = 1, 2


def _is_chrome(tag: str, attributes: str, inside: bool) -> int:
    if tag in CHROME_TAGS or tag == "header" and not inside:
        return BY_KIND
    found = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if found or tag in NAMELESS or inside and tag not in CONTAINERS:
                continue
            for v in value.split():
                if _is_role(v, inside or name == "id", inside) and (name == "class" or not inside or INNER_IDS & set(_NAME.findall(v.lower()))):
                    found = BY_NAME
        elif name == "role" and value.strip().lower() in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return BY_KIND
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return BY_KIND
    return found


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(role, text) of every non-empty block of a page, in order; chrome is left out.

    An element that is chrome by its name alone is none when all articles of the page are inside such elements
    and it holds one of them.
    """
    found, around = _blocks(html or "", frozenset())
    return _blocks(html or "", around)[0] if around else found


class _Open:
    """The open elements, with the places of each kind, so that an end tag finds its element without a search."""

    def __init__(self):
        self.rows: list[tuple[str, int, bool, int]] = []  # element, how it or one around it is chrome, is in an article, its place if named
        self.places: dict[str, list[int]] = defaultdict(list)
        self.fences: list[int] = []
        self.solid: list[int] = []  # those that are not inline
        self.named: list[int] = []

    def push(self, tag: str, chrome: int, inside: bool, named: int) -> None:
        at = len(self.rows)
        self.rows.append((tag, chrome, inside, named))
        self.places[tag].append(at)
        if tag in FENCES:
            self.fences.append(at)
        if tag not in INLINE:
            self.solid.append(at)
        if named:
            self.named.append(at)

    def cut(self, upto: int) -> None:
        """Close the element at ``upto`` and all inside it."""
        while len(self.rows) > upto:
            tag, _, _, named = self.rows.pop()
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()
            if tag not in INLINE:
                self.solid.pop()
            if named:
                self.named.pop()

    def top(self) -> tuple[str, int, bool, int]:
        return self.rows[-1] if self.rows else ("", 0, False, 0)

    def ended_by(self, tag: str) -> int | None:
        """The place of the element that this end tag closes."""
        at = self.places[tag][-1] if self.places.get(tag) else None
        if at is None or self.fences and self.fences[-1] > at and tag not in OVER_FENCES:
            return None  # a stray end tag does not leave a fence
        return at


def _blocks(html: str, exempt: frozenset[int]) -> tuple[list[tuple[int, str]], frozenset[int]]:
    """The blocks, and the places of the elements to exempt; names do not count for elements at ``exempt``."""
    found: list[tuple[int, str]] = []
    open_, held = _Open(), []
    plain, around = False, set()

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                found.append((ARTICLE if open_.top()[2] else OTHER, text))

    def leave(upto: int) -> None:
        close()
        open_.cut(upto)

    at, lower = 0, None
    while True:
        m = _TAG.search(html, at)
        upto = m.start() if m else len(html)
        if upto > at and not open_.top()[1]:
            held.append(html[at:upto])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        shut, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            held.append(" ")
        elif shut and tag in INLINE:
            if open_.top()[0] == tag:
                open_.cut(len(open_.rows) - 1)
        elif shut:
            ended = open_.ended_by(tag)
            if ended is not None:
                leave(ended)
            elif not open_.places.get(tag):
                close()
        elif tag in RAW:
            if tag not in INLINE:
                close() if tag not in ("script", "style", "noscript", "template") else None
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", at)
            if len(lower) != len(html):  # lower-casing may change lengths
                end = next((x.start() for x in re.compile(f"</{tag}", re.I).finditer(html, at)), -1)
            at = len(html) if end < 0 else end
        elif tag in VOID:
            if tag not in INLINE:
                close()
        else:
            if tag not in INLINE:
                close()
                if tag in ENDS_P:
                    if open_.solid and open_.rows[open_.solid[-1]][0] == "p":
                        leave(open_.solid[-1])
                elif tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
                    if open_.top()[0] == tag:
                        leave(len(open_.rows) - 1)
            above = open_.top()
            inside = above[2] or tag in ("article", "main")
            own = _is_chrome(tag, attributes, above[2])
            own = 0 if own == BY_NAME and at in exempt else own
            chrome = max(above[1], own)
            if tag in ("article", "main") and chrome == 0:
                plain = True
            elif tag in ("article", "main") and chrome == BY_NAME:
                for k in reversed(open_.named):
                    place = open_.rows[k][3]
                    if place in around:
                        break  # those around it are there too
                    around.add(place)
            if tag in INLINE and chrome == above[1]:
                continue  # inline elements matter only where they hide their text
            if attributes.rstrip().endswith("/") and tag in INLINE:
                continue
            open_.push(tag, chrome, inside, at if own == BY_NAME else 0)
    close()
    return found, frozenset() if plain else frozenset(around)


def _key(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")) - 2**63


#: Stand before and after a block's tokens, so that a whole block is told from a run inside a longer one.
BEGIN, END = "\ue000", "\ue001"


def windows(text: str) -> list[str]:
    """The runs of DEPTH tokens of a block, or the whole block between its marks if it has fewer."""
    tokens = text.split(" ")
    if len(tokens) < DEPTH:
        return [f"{BEGIN} {text} {END}"]
    return [" ".join(tokens[i : i + DEPTH]) for i in range(len(tokens) - DEPTH + 1)]


def windows_of(runs: list[str]) -> set[str]:
    """What covers the runs: the windows of the long ones, and the whole blocks."""
    return {w for run in runs for w in ([run] if run.startswith(BEGIN) else windows(run))}


_FACTORS, _TERMS = np.random.default_rng(42).integers(1, 2**63, (2, SKETCH, 1), dtype=np.uint64) | np.uint64(1)


def content(found: list[tuple[int, str]]) -> tuple[int, list[int]]:
    """A hash of a page's blocks, and the sketch of their token windows."""
    texts = [text for _, text in found]
    hashed = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in {w for text in texts for w in windows(text)}], np.uint64)
    lows = np.full((SKETCH, 1), 2**64 - 1, np.uint64)
    for at in range(0, len(hashed), 1 << 14):
        lows = np.minimum(lows, (hashed[at : at + (1 << 14)] * _FACTORS + _TERMS).min(axis=1, keepdims=True))
    return _key(texts), (lows[:, 0] >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


def unique_text(found: list[tuple[int, str]], repeated: Set[str], common: Set[str] = frozenset()) -> str:
    """The blocks without what the windows cover (``repeated``: outside an article, ``common``: inside), joined by two line feeds."""
    if repeated or common:
        kept = []
        for role, text in found:
            gone = common if role == ARTICLE else repeated
            own = windows(text)
            if gone.isdisjoint(own):
                kept.append((role, text))
            elif len(own) > 1 or not own[0].startswith(BEGIN):
                tokens = text.split(" ")
                covered = [False] * len(tokens)
                for i, window in enumerate(own):
                    if window in gone:
                        covered[i : i + DEPTH] = [True] * DEPTH
                left = [t for t, c in zip(tokens, covered, strict=True) if not c]
                if left:
                    kept.append((role, " ".join(left)))
        found = kept or found  # nothing unique: the page is a copy
    return "\n\n".join(text for _, text in found)


def _enough(n, pages, share: float, least: int):
    """Whether n of so many pages make a run boilerplate."""
    return (n >= least) & (n > share * pages)


def repeated_runs(group: list[list[tuple[int, str]]], all_pages: int) -> tuple[set[str], set[str]]:
    """(runs to go from other blocks, runs to go from articles) of a group of pages of one host, by its suffix array.

    The tokens of all blocks make one stream; a mark that occurs once ends each block, so no run goes on
    into the next.  An interval of the suffix array is a substring with all its places.  The longest
    that enough pages hold is kept at each place, unless it only continues the one a token before.  Of a
    host of several groups (``all_pages`` over the group's) shares alone decide: the least numbers of pages are
    held against the exact counts later.
    """
    names: dict[str, int] = {}
    code, page, marks, words = [], [], 0, []
    for k, found in enumerate(group):
        for _, text in found:
            tokens = [BEGIN, *text.split(" "), END]
            words += [*tokens, ""]
            code += [names.setdefault(t, len(names)) for t in tokens]
            marks -= 1
            code.append(marks)
            page += [k] * (len(tokens) + 1)
    if not code:
        return set(), set()
    data, page = np.array(code, np.int64), np.array(page)
    pages, whole = len(group), all_pages <= len(group)
    order, common = suffix_order(data, np.array([len(data)]))
    out = []
    for share, least in ((OTHER_SHARE, OTHER_PAGES), (COMMON_SHARE, COMMON_PAGES)):
        longest = np.zeros(len(data), np.int64)
        for first, size, length, _ in zip(*(x.tolist() for x in lcp_intervals(common, 3)), strict=True):
            begin = int(order[first])
            is_block = words[begin] == BEGIN and words[begin + length - 1] == END
            tokens = length - (words[begin] == BEGIN) - (words[begin + length - 1] == END)
            if size < 2 or not is_block and tokens < DEPTH or whole and size < least or size <= share * pages:
                continue
            places = order[first : first + size]
            if _enough(len(np.unique(page[places])), pages, share, least if whole else 1):
                longest[places] = np.maximum(longest[places], length)
        starts = np.flatnonzero((longest > 0) & (longest > np.r_[0, longest[:-1] - 1]))
        runs = set()
        for at in starts.tolist():
            run = words[at : at + int(longest[at])]
            if not (run[0] == BEGIN and run[-1] == END and len(run) < DEPTH + 2):
                run = [t for t in run if t not in (BEGIN, END)]
            runs.add(" ".join(run))
        out.append(runs)
    return out[0], out[1]


PARSED = "uid long, page_id long, url string, host string, content long, sketch array<int>, packed binary"


def pack(found: list[tuple[int, str]]) -> bytes:
    """A page's blocks, compressed: they are staged once and shuffled once."""
    lines = "\n".join(f"{role}{text}" for role, text in found)  # a block has no line feed: its white space is single spaces
    return zstandard.ZstdCompressor(level=3).compress(lines.encode("utf-8", "surrogatepass"))


def unpack(packed: bytes) -> list[tuple[int, str]]:
    lines = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
    return [(int(line[0]), line[1:]) for line in lines.split("\n")] if lines else []


def parse(pages: DataFrame) -> DataFrame:
    """The pages as blocks, staged: PARSED; a page without text has no content and no sketch."""
    host, _ = host_and_path(F.col("url"))
    rows = spread(only(pages, page_id="long", url="string", html="string")).select(
        F.xxhash64("page_id", "url", "html").alias("uid"), "page_id", "url", F.coalesce(host, F.lit("")).alias("host"), "html"
    )
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sketches, packed = [], [], []
            for html in batch.column("html"):
                found = blocks(html.as_py())
                hashed, lows = content(found) if found else (None, None)
                hashes.append(hashed)
                sketches.append(lows)
                packed.append(pack(found))
            columns = [pa.array(c, k) for c, k in zip((hashes, sketches, packed), kinds, strict=True)]
            yield pa.record_batch([*batch.columns[:4], *columns], names=["uid", "page_id", "url", "host", "content", "sketch", "packed"])

    return stage(rows.mapInArrow(run, PARSED), "html-parsed")


def copies(indexed: DataFrame) -> DataFrame:
    """(uid): the pages that another page of the host stands for, as copies or near copies."""
    sketched = indexed.select("uid", "host", "content", "sketch")
    own = sketched.groupBy("host", "content").agg(F.min("uid").alias("first"))
    same = sketched.join(own, ["host", "content"]).where("uid <> first").select("uid")
    firsts = stage(sketched.join(own.select(F.col("first").alias("uid")), "uid").dropDuplicates(["uid"]), "html-firsts")
    # a band is one number with its host and place; where numbers meet by chance, the sketches or the hosts differ
    banded = F.explode(F.array(*[F.xxhash64("host", F.lit(i), F.slice("sketch", i * BAND + 1, BAND)) for i in range(SKETCH // BAND)]))
    bands = firsts.select("uid", banded.alias("band"))
    met = bands.groupBy("band").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low <> high").select("band", "low")
    pairs = stage(bands.join(met, "band").where("uid <> low").select("uid", "low").distinct(), "html-pairs")
    sketches = firsts.select(F.col("uid").alias("low"), F.col("sketch").alias("of_low"), F.col("host").alias("host_of_low"))
    both = pairs.join(firsts.select("uid", "host", "sketch"), "uid").join(sketches, "low").where("host = host_of_low")
    agree = F.size(F.filter(F.zip_with("sketch", "of_low", lambda x, y: x == y), lambda x: x))
    links = stage(both.where(agree >= AGREE).select(F.col("uid").alias("a"), F.col("low").alias("b")), "html-links")
    if not links.isEmpty():
        joined = connected_components(links, "html-groups")
        same = same.union(joined.where("node <> component").select("node"))
    out = stage(same.distinct(), "html-copies")
    drop(firsts, pairs, links)
    return out


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, other, article): the runs of each host that go from other blocks and from articles.

    ``pages`` (uid, host, packed) has one page for each group of copies.
    """
    sizes = stage(pages.select("uid", "host").distinct().groupBy("host").agg(F.count("*").alias("pages")).where("pages > 1"), "html-sizes")
    part = F.pmod("uid", F.ceil(F.col("pages") / GROUP)).alias("part")
    dealt = pages.join(sizes, "host").select("uid", "host", part, "pages", "packed").repartition("host", "part").sortWithinPartitions("host", "part")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, group, total = None, set(), [], 0

        def runs() -> pa.RecordBatch:
            if len(group) < total and OTHER_SHARE * len(group) < 1:  # so small a group that one page is over the share: all of it is to be counted
                other = article = {w for found in group for _, text in found for w in windows(text)}
            else:
                other, article = repeated_runs(group, total)
            rows = [(key[0], r, r in other, r in article) for r in sorted(other | article)]
            if len(group) < total:  # to be counted a window at a time
                windowed = [{w for run in own for w in windows_of([run])} for own in (other, article)]
                rows = [(key[0], w, w in windowed[0], w in windowed[1]) for w in sorted(windowed[0] | windowed[1])]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["host", "run", "other", "article"])

        for batch in batches:
            for uid, host, p, n, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (host, p) != key:
                    if group:
                        yield runs()
                    key, seen, group, total = (host, p), set(), [], n
                if uid not in seen:
                    seen.add(uid)
                    group.append(unpack(packed))
        if group:
            yield runs()

    found = stage(dealt.mapInArrow(local, "host string, run string, other boolean, article boolean"), "html-runs")
    maybe = found.groupBy("host", "run").agg(F.max("other").alias("other"), F.max("article").alias("article")).join(sizes, "host")
    single = maybe.where(F.col("pages") <= GROUP)
    wide = stage(maybe.where(F.col("pages") > GROUP).groupBy("host").agg(F.collect_list("run").alias("runs")), "html-maybe")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, own, run, held = [], [], [], (None, frozenset())
            for u, h, packed, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if h != held[0]:
                    held = (h, frozenset(runs.as_py()))
                met = {w for _, text in unpack(packed) for w in windows(text)} & held[1]
                uid += [u] * len(met)
                own += [h] * len(met)
                run += met
            yield pa.record_batch([pa.array(uid, pa.int64()), pa.array(own, pa.string()), pa.array(run, pa.string())], names=["uid", "host", "run"])

    if not wide.isEmpty():
        met = pages.join(wide, "host").select("uid", "host", "packed", "runs").mapInArrow(carried, "uid long, host string, run string")
        counted = met.distinct().groupBy("host", "run").agg(F.count("*").alias("n")).join(sizes, "host")
        other, article = _enough(F.col("n"), F.col("pages"), OTHER_SHARE, OTHER_PAGES), _enough(F.col("n"), F.col("pages"), COMMON_SHARE, COMMON_PAGES)
        single = single.select("host", "run", "other", "article").union(counted.select("host", "run", other.alias("other"), article.alias("article")))
    listed = lambda c: F.collect_list(F.when(F.col(c), F.col("run"))).alias(c)
    out = stage(single.where("other or article").groupBy("host").agg(listed("other"), listed("article")), "html-boilerplate")
    drop(found, sizes)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    parsed = parse(pages)
    indexed = parsed.where("content is not null")
    gone = copies(indexed.select("uid", "host", "content", "sketch"))
    # one page stands for its copies; repeated rows have one uid
    free_shuffles(pages.sparkSession)
    common = boilerplate(indexed.select("uid", "host", "packed").join(gone, "uid", "left_anti"))

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = (None, frozenset(), frozenset()), []
            for host, packed, other, article in zip(*(batch.column(i).to_pylist() for i in (2, 3)), batch.column(4), batch.column(5), strict=True):
                if host != held[0]:
                    held = (host, windows_of(other.as_py() or ()), windows_of(article.as_py() or ()))
                out.append(unique_text(unpack(packed), held[1], held[2]))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    met = parsed.select("page_id", "url", "host", "packed").join(common, "host", "left").select("page_id", "url", "host", "packed", "other", "article")
    return met.mapInArrow(text, "page_id long, url string, text string, n_chars long")
