"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their own blocks, less what stands in links. Every container votes, with
its score, for its generalised path (tags with their classes, digits left out) on its host; the votes, whole numbers, are
added up in Spark. Each page is then read from the container on the path that most of its host's text voted for, of those
paths that the page has, and on those of its other paths whose own blocks, without those of containers in them, have more
than SHARE of the most that any path of the host has: an article may lie in containers side by side.

Names of classes and tags that tell of menus, adverts, comments and the like lower the votes of what they hold, and leave it out of a
winner that has other text. They never leave out a winner or what it lies in, so a page's text is found under any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, small_or_shuffled, staged

#: Chosen paths, of all pages, up to which they are broadcast.
BROADCAST_PATHS = 200_000

#: Share of the largest path's own text above which a path is read besides the winning one, wherever it lies. Those beside the winning one are read whatever their size.
SHARE = 0.25
#: Votes of a character, and the bits by which a name halves them: a sixty-fourth.
VOTES, LOWERED = 1 << 12, 6

# Tags of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BESIDE = {"nav", "header", "footer", "aside", "form", "menu", "label", "fieldset", "select", "button", "dialog", "audio", "video"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "content"}
BLOCKS = CONTAINERS | BESIDE | {
    "address", "blockquote", "caption", "dd", "details", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr",
    "head", "html", "li", "ol", "p", "pre", "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul",
}
#: Open tags that a new one of these ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes, ids and roles that name what is no main text, as a whole name or as its last word.
NOISE = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "masthead", "topbar", "footer", "sidebar", "aside",
    "complementary", "contentinfo", "notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "disclaimer", "toolbar",
    "share", "sharing", "social", "recommended", "recommendations", "newsletter", "subscribe", "signup", "login", "search", "form", "copyright", "header", "banner",
    "ad", "ads", "adsbygoogle", "advert", "adverts", "advertisement", "advertising", "adbox", "sponsor", "sponsored", "promo", "promotion", "widget", "related",
    "comment", "comments", "disqus", "replies", "respond", "reply", "discussion",
}
#: Beginnings of words that are such names in longer forms too.
STEMS = ("comment", "sidebar", "breadcrumb", "advert", "newsletter", "sponsor", "footer")
#: Last words with which one of these ahead is no main text either.
LISTS = {"area", "articles", "bar", "block", "box", "button", "buttons", "icons", "item", "items", "links", "list", "posts", "section", "stories", "thread", "unit", "units", "wrapper"}
#: Headers of an article itself, by their first word.
TITLED = {"post", "entry", "article", "story", "content"}
#: Containers that hold the main text whole, by the last word, unless the first names what is no main text: they aren't split further, and no other name makes them noise.
WHOLE = {"content", "article", "post", "entry", "story", "main"}
KEPT = {"main", "body", "html"}

# As HTML reads tags: a quote counts at the start of a value only; one that nothing closes is part of an unquoted value.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++))?+)?+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE.replace("([", "(?:[")})*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(rf"[\s/]*+{_ATTRIBUTE}")
_TELLS = re.compile("class|id|role|hidden", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_SENTENCE = tuple(".!?…。！？") + tuple(end + quote for end in ".!?" for quote in "\"')”’")


def _noisy(token: str) -> bool:
    words = [w.lower() for w in _WORD.findall(token)]
    if not words or "".join(words) in NOISE:
        return bool(words)
    if words[-1] == "header" and words[0] in TITLED:
        return False
    if len(words) == 1:
        return words[0].startswith(STEMS)
    return words[-1] in NOISE or words[-1] in LISTS | WHOLE and (words[0] in NOISE or words[0].startswith(STEMS))


@lru_cache(1 << 16)
def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The generalised name; whether names or flags say that this is no main text; whether they say that it is."""
    klass, noise, whole, hidden, beaten = "", False, False, False, False
    if _TELLS.search(attributes):
        for m in _ATTR.finditer(attributes):
            name = m[1].lower()
            if name not in ("class", "id", "role", "hidden", "aria-hidden"):
                continue
            value = html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("hidden", "aria-hidden"):
                hidden |= name == "hidden" or value.lower() == "true"
                continue
            for token in value.split():
                bad = _noisy(token)
                noise |= bad
                beaten |= bad and (_WORD.findall(token) or [""])[-1].lower() in WHOLE
                whole |= not bad and (_WORD.findall(token) or [""])[-1].lower() in WHOLE
            klass = value if name == "class" else klass
    noise = tag not in KEPT and (hidden or tag in BESIDE or beaten or noise and not whole)
    return re.sub(r"\d+", "", ".".join([tag, *sorted(klass.split())])) + "!" * noise, noise, whole


class Page:
    """A page's blocks of text in page order, each with the place of the innermost container round it (-1: none); and its containers, outer ones first."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.weights: list[int] = []  # characters less those in links, twice
        self.at: list[int] = []
        self.parents: list[int] = []
        self.paths: list[int] = []  # hashes of the generalised paths
        self.names: list[str] = []
        self.noise: list[bool] = []
        self._read(page)

    def _open(self, parent: int, name: str, noise: bool) -> int:
        self.parents.append(parent)
        self.paths.append(xxhash.xxh64_intdigest(name, self.paths[parent] if parent >= 0 else 0))
        self.names.append(name)
        self.noise.append(noise)
        return len(self.parents) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, str]] = []  # tag, and what held ahead of it: container and kind of whole container
        opened: dict[str, int] = {}  # open elements by tag
        unclosed: set[str] = set()
        here, within = -1, ""
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = "".join(parts)
                text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
                if text:
                    self.texts.append(text)
                    self.weights.append(max(0, len(text) - 2 * linked))
                    self.at.append(here)
                parts, linked = [], 0

        def pop() -> str:
            nonlocal here, within
            tag, here, within = stack.pop()
            opened[tag] -= 1
            return tag

        at, size = 0, len(page)
        while at < size:
            m = _TAG.search(page, at)
            end = m.start() if m else size
            if end > at and not opened.get("head"):
                piece = page[at:end]
                parts.append(piece)
                linked += len(piece) if opened.get("a") else 0
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCKS:
                flush()
            if m[1]:
                if opened.get(tag):
                    while pop() != tag:
                        pass
                continue
            if tag in RAW:
                close = None if tag in unclosed else re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = size
                else:
                    unclosed.add(tag)
                continue
            if tag == "body" and opened.get("head"):
                while pop() != "head":
                    pass
            while stack and stack[-1][0] in ENDS.get(tag, ()):
                pop()
            attributes = m[3]
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                continue
            name, noise, whole = _named(tag, attributes)
            stack.append((tag, here, within))
            opened[tag] = opened.get(tag, 0) + 1
            if noise or tag in CONTAINERS and (not within or tag == "article" and within != "article"):
                if tag not in BLOCKS and noise:
                    flush()
                here = self._open(here, name, noise)
                if tag in CONTAINERS:
                    within = "article" if tag == "article" else "main" if tag == "main" or whole and tag != "body" else within
        flush()

    def votes(self) -> dict[int, list]:
        """By path: votes of the text in its containers, halved with each container between; of the own text alone; how many names lower them; the path above, and whether that is the page itself; and how many blocks of own text end a sentence."""
        out: dict[int, list] = {}
        lowered: list[int] = []
        for parent, noise in zip(self.parents, self.noise, strict=True):
            lowered.append((lowered[parent] if parent >= 0 else 0) + noise)
        for node, weight, text in zip(self.at, self.weights, self.texts, strict=True):
            vote, own = (weight * VOTES >> LOWERED * lowered[node], True) if node >= 0 else (0, False)
            while node >= 0 and (vote or own):
                above = self.parents[node]
                outer = above < 0 or self.names[above].startswith(("body", "html"))
                kept = out.setdefault(self.paths[node], [0, 0, lowered[node], self.paths[above] if above >= 0 else 0, outer, 0])
                kept[0] += vote
                kept[1] += vote if own else 0
                kept[5] += own and text.endswith(_SENTENCE)
                vote, own, node = vote >> 1, False, self.parents[node]
        return out


def read_at(texts: list[str], at: list[int], parents: list[int], paths: list[int], noise: list[bool], read: set[int]) -> list[str]:
    """The blocks within containers on the paths, less those within noise in these, unless nothing else is there; all blocks if `read` is empty."""
    if not read:
        return texts
    for strict in (True, False):
        inside: list[bool] = []
        for parent, path, noisy in zip(parents, paths, noise, strict=True):
            inside.append(path in read or (parent >= 0 and inside[parent] and not (strict and noisy)))
        if found := [text for text, node in zip(texts, at, strict=True) if node >= 0 and inside[node]]:
            return found
    return []


_PARSED = "page_id long, url string, host string, texts array<string>, at array<int>, parents array<int>, paths array<long>, names array<string>, noise array<boolean>, votes array<struct<path:bigint,score:bigint,own:bigint,lowered:int,above:bigint,outer:boolean,told:int>>"


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vote = pa.struct([("path", pa.int64()), ("score", pa.int64()), ("own", pa.int64()), ("lowered", pa.int32()), ("above", pa.int64()), ("outer", pa.bool_()), ("told", pa.int32())])
    kinds = {"texts": pa.string(), "at": pa.int32(), "parents": pa.int32(), "paths": pa.int64(), "names": pa.string(), "noise": pa.bool_(), "votes": vote}
    for batch in batches:
        for lo in range(0, len(batch), 64):  # so that only so many parsed pages are held at once
            part = batch.slice(lo, 64)
            columns: dict[str, list] = {c: [] for c in kinds}
            for page in part.column("html"):
                p = Page(page.as_py() or "")
                votes = [{"path": _signed(k), "score": s, "own": o, "lowered": n, "above": _signed(above), "outer": outer, "told": told} for k, (s, o, n, above, outer, told) in p.votes().items()]
                for c, x in zip(kinds, (p.texts, p.at, p.parents, [_signed(k) for k in p.paths], p.names, p.noise, votes), strict=True):
                    columns[c].append(x)
            arrays = [pa.array(columns[c], pa.list_(kind)) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), part.column("host"), *arrays], names=["page_id", "url", "host", *kinds])


def _label(node: int, parents: list[int], names: list[str]) -> str:
    """The last names of a container's path."""
    out: list[str] = []
    while node >= 0 and len(out) < 6:
        out.append(names[node])
        node = parents[node]
    return ">".join(reversed(out))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("texts", "at", "parents", "paths", "noise", "names", "best", "also")
    for batch in batches:
        texts, used = [], []
        for row in zip(*(batch.column(c) for c in fields), strict=True):
            blocks, at, parents, paths, noise, names, best, also = (x.as_py() for x in row)
            texts.append(" ".join(read_at(blocks, at, parents, paths, noise, {best, *(also or [])} if best is not None else set())))
            used.append(_label(paths.index(best), parents, names) if best is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(used, pa.string())], names=["page_id", "url", "text", "path"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_texts(pages: DataFrame, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every row of pages (page_id, url, html).

    text: the blocks inside the winning containers and those beside them (see above), in page order, each with its
    character references decoded and its white space turned into single spaces, joined by one space. path: the last names
    of the winning path, with ! after those that lower votes; null if the page has no container with text.

    Null or empty html: empty text. Null urls and those without a host share the host ''. Repeated rows vote and are
    returned each. Ties between paths go to the smaller hash of the path. Other columns are ignored. An empty table: no rows.
    """
    pages = only(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    parsed = staged(pages.mapInArrow(_parsed, _PARSED).withColumn("row", F.monotonically_increasing_id()))
    votes = parsed.select("row", "host", F.explode("votes").alias("x")).select("row", "host", "x.*")
    ranked = staged(votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("own").alias("own"), F.min("lowered").alias("lowered"), F.min("above").alias("above"), F.min("outer").alias("outer"), F.sum("told").alias("told"), F.count("*").alias("pages")))
    tops = ranked.groupBy("host").agg(F.max(F.struct("own", (-F.col("lowered")).alias("raised"))).alias("top"))
    also = (F.col("own") > F.col("top.own") * SHARE) & (-F.col("lowered") >= F.col("top.raised"))
    facts = ["above", "own", "lowered", "pages", "outer", "told"]
    ranked = staged(ranked.join(small_or_shuffled(staged(tops)), "host").select("host", "path", (-F.col("score")).alias("low"), also.alias("also"), *facts))  # so that the join with a common path's rows can be split
    of_page = votes.select("row", "host", "path").join(ranked, ["host", "path"])
    best, path = F.struct("low", "path", *facts), F.struct("path", "also", *facts)
    chosen = of_page.groupBy("row").agg(F.min(best).alias("x"), F.collect_set(path).alias("paths"))
    # beside the winner: under the same container, no name against it, more text than links on the host, and on half as many of its pages at least; right under the page itself, where all kinds of boxes stand, sentences too
    beside = lambda p: (p["above"] == F.col("x.above")) & (p["own"] > 0) & (p["lowered"] <= F.col("x.lowered")) & (2 * p["pages"] >= F.col("x.pages")) & (~p["outer"] | (p["told"] > 0))
    read = F.transform(F.filter("paths", lambda p: p["also"] | beside(p)), lambda p: p["path"])
    chosen = small_or_shuffled(staged(chosen.select("row", F.col("x.path").alias("best"), read.alias("also"))), broadcast_paths, 1 + F.size("also"))
    out = parsed.drop("votes", "host").join(chosen, "row", "left").mapInArrow(_extracted, "page_id long, url string, text string, path string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
