"""Main text of web pages, with site templates removed.

A page is read into a tree of elements. Every element that holds text outside the
page's article gets a hash of its subtree (tag, children, text); Spark counts on how
many pages of a host, and of each of its path sections, each hash stands, and subtrees
that recur on many pages of the host or section are deleted there. From what remains, elements are left out that are never main text
by their tag, role, class or id (menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles). Blocks of the rest are the text. A class or id of
which a word only is noise ("has-sidebar") never hides an article, and none hides main;
one that is noise as a whole ("comments") hides articles only beside other text.
Inside an article only a class that is noise as a whole hides an element ("comments",
"comment-list", but not "no-ads"), or such an id of a container; what is named otherwise goes
only if its host's counts say so.

Where a page marks its article (article or main), that part is the main text. In it,
containers (div, section, lists, tables; never paragraphs, headings or quotations, so
that pages may quote each other) are deleted if they stand in at least half of the
host's articles. Articles with the same text count once, and a container counts only
where it holds the lesser part of the article: copies of one article delete nothing.
Counting is by (host, hash) with map-side combining, so a host with a third of all
pages is spread. Pages are then read a second time from the input, beside what is
deleted of each; only hashes are written in between.

Defined cases: a null or empty page gives an empty text; broken markup is read as
far as it goes (unclosed elements end with their parent, a stray "<" is text); a line
break inside a block is white space like any other, so it becomes one space; pages of
any length and depth are read whole, in time that follows their length; rows
with a null page_id lose no templates; rows that share a page_id share what is
deleted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_PAGES, MIN_SHARE, INSIDE_SHARE = 5, 0.01, 0.5
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)

# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template svg math".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr".split()
)
NEVER = set("head nav footer aside form button select option input dialog menu object embed canvas audio video fieldset".split()) | RAW
ARTICLE = {"article", "main"}
CONTAINER = set("div section ul ol dl table details figure address center header hgroup".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{k: {"p"} for k in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
NOISE = set(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation
    breadcrumb breadcrumbs cookie cookies consent notice notices popup modal alert comment comments comm disqus reply replies respond share sharing social
    related recommended newsletter subscribe signup login footer foot header masthead topbar widget pagination pager toc contentinfo complementary search announcement toast gdpr""".split()
)


# Words that may stand beside one of the above in a class that is noise as a whole ("comment-list", "reader-comments").
BESIDE = set("area bar block body box button buttons container form icons inner links list outer panel post posts reader section site slot thread unit user wrap wrapper".split())
#: Words that are noise outside articles only.
OUTER = {"header", "side", "top"}

# How an element is noise: by tag or hidden, by a word of its class or id, by a whole class or id.
BY_TAG, BY_WORD, BY_NAME = 1, 2, 3


class Node:
    __slots__ = ("tag", "noise", "parts", "key")

    def __init__(self, tag: str, noise: int):
        self.tag, self.noise, self.parts, self.key = tag, noise, [], None


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def noise_name(name: str) -> bool:
    """Whether a class is noise as a whole: of its words one is, and all are noise or stand beside noise."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in NOISE and w not in OUTER for w in words) and all(w in NOISE or w in BESIDE for w in words)


def named_noise(tag: str, names: dict[str, str], in_article: bool) -> int:
    """Whether whole classes, ids or roles, or words of them, are noise. In an article only whole classes and roles are,
    and whole ids of containers: a heading or paragraph may be named like anything."""
    found = 0
    for kind in ("class", "id", "role"):
        value = names.get(kind, "").lower()
        if not in_article:
            for how, parts in ((BY_NAME, value.split()), (BY_WORD, re.split(r"[^a-z]+", value))):
                if any(w in NOISE for w in parts):
                    found = max(found, how)
        elif (kind != "id" or tag in CONTAINER) and any(map(noise_name, value.split())):
            found = BY_NAME
    return found


def is_noise(tag: str, attributes: str, in_article: bool) -> int:
    """Whether, and how, an element is never main text; an article's own header is."""
    if tag in NEVER or tag == "header" and not in_article:
        return BY_TAG
    if not attributes or tag in ("body", "html"):
        return 0
    names = attributes_of(attributes)
    if "hidden" in names or names.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(names.get("style", "")):
        return BY_TAG
    found = named_noise(tag, names, in_article)
    return 0 if tag in ARTICLE and found == BY_WORD else found


class Open:
    """The open elements, with what makes each step of parse() cheap however deep they stand."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.counts: dict[str, int] = {}  # open elements by tag
        self.blocks = [0]  # places in the stack of all but inline elements
        self.inline: list[dict[str, int]] = [{}]  # inline elements above each of these, by tag
        self.articles = 0
        self.seen: dict[tuple[bool, bool], int] = {}  # how far up articles of a kind have looked already

    def push(self, node: Node) -> None:
        if node.tag in INLINE:
            self.inline[-1][node.tag] = self.inline[-1].get(node.tag, 0) + 1
        else:
            self.blocks.append(len(self.stack))
            self.inline.append({})
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1
        self.articles += node.tag in ARTICLE
        self.stack.append(node)

    def cut(self, size: int) -> None:
        """Close all elements from a place in the stack on."""
        while len(self.stack) > size:
            node = self.stack.pop()
            self.counts[node.tag] -= 1
            self.articles -= node.tag in ARTICLE
            if node.tag in INLINE:
                self.inline[-1][node.tag] -= 1
            else:
                self.blocks.pop()
                self.inline.pop()
        for kind, depth in self.seen.items():
            self.seen[kind] = min(depth, size)

    def close(self, tag: str) -> None:
        """An end tag: it closes its element; an inline one does so only within its block."""
        if not (self.inline[-1] if tag in INLINE else self.counts).get(tag):
            return
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            at -= 1
        self.cut(at)

    def make_way(self, tag: str) -> None:
        """A start tag closes the elements before it that cannot hold it."""
        closes = CLOSES.get(tag, ())
        while self.stack[self.blocks[-1]].tag in closes:
            self.cut(self.blocks[-1])


def parse(page: str) -> Node:
    root = Node("", False)
    open_, at, size, last = Open(root), 0, len(page), page.rfind(">")
    around: list[tuple[Node, bool]] = []  # elements that hide an article by name, and whether its own name is free of noise
    while at < size:
        m = TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        top = open_.stack[-1]
        if not m:
            top.parts.append(page[at:])
            break
        if m.start() > at:
            top.parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close(tag)
            continue
        open_.make_way(tag)
        stack = open_.stack
        node = Node(tag, is_noise(tag, m[3], open_.articles > 0))
        stack[-1].parts.append(node)
        if tag in ARTICLE and not node.noise:
            free = not named_noise(tag, attributes_of(m[3]), False)
            kind = tag == "main", free
            for n in reversed(stack[open_.seen.get(kind, 0) :]):
                if n.tag == "article" and not n.noise:
                    break
                if n.noise == BY_WORD or n.noise == BY_NAME and tag == "main":
                    n.noise = 0
                elif n.noise == BY_NAME:
                    around.append((n, free))
            open_.seen[kind] = len(stack)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[0].endswith("/>"):
            open_.push(node)
    if around and not articles(root):
        for n, free in around:
            n.noise = 0 if free else n.noise
    if around and not text_of(root, set()):
        for n, _ in around:
            n.noise = 0
    return root


def articles(root: Node) -> list[Node]:
    """The outermost marked articles that aren't noise, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in ARTICLE and not node.noise:
            out.append(node)
        elif not node.noise:
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def hash_outside(root: Node) -> list[int]:
    """Hashes of all subtrees with text outside articles, and of each node its key."""
    out: list[int] = []
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag not in ARTICLE or node.noise:
            stack.extend(p for p in node.parts if isinstance(p, Node))
    for node in reversed(order):  # children first
        if node.tag in ARTICLE and not node.noise:
            continue
        text, some, open_ = [node.tag], False, False
        for p in node.parts:
            if isinstance(p, Node):
                open_ |= p.tag in ARTICLE and not p.noise or p.key == -1
                some |= p.key is not None
                text.append(str(p.key))
            elif words := " ".join(p.split()):
                some = True
                text.append(words)
        if open_:
            node.key = -1  # around an article: no template
        elif some and node.tag:
            node.key = xxhash.xxh3_64_intdigest("\x1f".join(text).encode("utf-8", "replace")) >> 1
            out.append(node.key)
    return out


def hash_inside(root: Node) -> tuple[int | None, list[int], list[int]]:
    """A hash of all text in articles, hashes of the containers there (each node its key), and of those with the lesser part of the text."""
    order, stack = [], articles(root)
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.noise)
    words = [w for node in order for p in node.parts if isinstance(p, str) and (w := " ".join(p.split()))]
    if not words:
        return None, [], []
    article = xxhash.xxh3_64_intdigest("\x1f".join(words).encode("utf-8", "replace")) >> 1
    if not any(node.tag in CONTAINER for node in order):
        return article, [], []
    total, done = sum(map(len, words)), {}
    held, lesser = set(), set()
    for node in reversed(order):  # children first
        text, size = ["in", node.tag], 0
        for p in node.parts:
            if isinstance(p, str):
                if w := " ".join(p.split()):
                    text.append(w)
                    size += len(w)
            elif p in done:
                text.append(str(done[p][0]))
                size += done[p][1]
        if size:
            key = xxhash.xxh3_64_intdigest("\x1f".join(text).encode("utf-8", "replace")) >> 1
            done[node] = key, size
            if node.tag in CONTAINER:
                node.key = key
                held.add(key)
                if 2 * size < total:
                    lesser.add(key)
    return article, sorted(held), sorted(lesser)


def blocks_of(nodes: list[Node], deleted: set[int]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    stack: list = list(reversed(nodes))
    while stack:
        p = stack.pop()
        if p is None:
            close()
        elif isinstance(p, str):
            held.append(p)
        elif p.noise or p.tag == "br" or p.key is not None and p.key in deleted:
            held.append(" ")
        elif p.tag in INLINE:
            stack.extend(reversed(p.parts))
        else:
            close()
            stack.append(None)
            stack.extend(reversed(p.parts))
    close()
    return out


def text_of(root: Node, deleted: set[int]) -> str:
    return "\n".join(blocks_of(articles(root) or [root], deleted))


def main_text(page: str | None, deleted: set[int] = frozenset()) -> str:
    root = parse(page or "")
    if deleted:
        hash_outside(root)
        hash_inside(root)
    return text_of(root, deleted)


KEYS = "page_id long, host string, section string, marked boolean, keys array<long>, article long, held array<long>, lesser array<long>"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each page outside and inside its articles."""
    for batch in batches:
        found = []
        for page in batch.column("html").to_pylist():
            root = parse(page or "")
            found.append((bool(articles(root)), sorted(set(hash_outside(root))), *hash_inside(root)))
        marked, keys, article, held, lesser = zip(*found) if found else [()] * 5
        longs = pa.list_(pa.int64())
        columns = [pa.array(marked, pa.bool_()), pa.array(keys, longs), pa.array(article, pa.int64()), pa.array(held, longs), pa.array(lesser, longs)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "section")), *columns], ["page_id", "host", "section", "marked", "keys", "article", "held", "lesser"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h, set(d or ())) for h, d in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "html")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    section = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]+/([^/?#]+)/", 1), F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), section.alias("section"), "html")
    read = scratch.keep(known.where("page_id is not null").mapInArrow(_keys, KEYS), "read")
    placed = read.withColumn("place", F.explode(F.array("host", F.concat_ws("/", "host", "section"))))
    places = placed.groupBy("place").agg(F.count("*").alias("pages"))
    counts = placed.select("place", F.explode("keys").alias("key")).groupBy("place", "key").agg(F.count("*").alias("n"))
    outside = counts.where(F.col("n") >= min_pages).join(places, "place").where(F.col("n") >= min_share * F.col("pages")).select("place", "key")
    hosts = read.groupBy("host").agg(F.count_distinct("article").alias("articles"))
    votes = read.select("host", "article", F.explode("lesser").alias("key")).distinct()
    counts = votes.groupBy("host", "key").agg(F.count("*").alias("n"))
    inside = counts.where(F.col("n") >= min_pages).join(hosts, "host").where(F.col("n") >= inside_share * F.col("articles")).select("host", "key")
    around = placed.where("not marked").select("page_id", "place", F.explode("keys").alias("key")).join(outside, ["place", "key"])
    within = read.select("page_id", "host", F.explode("held").alias("key")).join(inside, ["host", "key"])
    wanted = around.select("page_id", "key").unionByName(within.select("page_id", "key")).groupBy(F.col("page_id").alias("__id")).agg(F.collect_set("key").alias("deleted"))
    deleted = scratch.keep(wanted, "deleted")
    scratch.drop("read")
    joined = known.join(deleted, F.col("page_id") == F.col("__id"), "left").select("page_id", "url", "html", "deleted")
    out = joined.mapInArrow(_texts, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
