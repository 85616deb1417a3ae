"""Main text of web pages: site templates by counted subtree hashes, then the article's blocks.

Each page is read into a tree by a forgiving reader (implied end tags, unclosed and cut-off markup, raw
text elements). Every container element outside the article gets a hash of its tags, classes and text; Spark counts
with how many different article texts of a host each hash occurs, and subtrees that recur with ENOUGH of them, or
with MIN_PAGES that are MIN_SHARE of the host's, are deleted. Pages of equal article text count once, so copies of a page, and
copies in another frame, do not make its text a template. The article is what lies below main, article or
the element that holds the first h1, and all that follows that heading: no subtree goes there for its hash, so
a body, list or table that many articles share stays. Then elements that are no article text by their tag, role
or class go, and the text of main and of the articles, else of the body, is taken block by block.

A class or id tells only where all its parts are known words (``social-history`` is not ``social``). What goes by
role or class, or as a form, stays where the main text lies in it: the largest main, else the largest article
that is no comment itself; on a page with neither, the first h1 together with the greater part of the page's words.

The counts are aggregated before they are shuffled, by host and hash together, so that a host with a third
of all pages is as many keys as it has subtrees. Pages travel only if they hold a template.

Defined results: a null or empty page has an empty text; character references are decoded, white space
inside a block is one space, blocks are joined by one line feed; a line break element is white space; a page of any
length is read whole; a null url is a host of its own, with an empty name; rows stay as they come, repeated ones
too; an empty table gives an empty one; an input column that has the name of a result is replaced, others may have any name.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import claim, cut, drop, free, ship
from tessera.llm.url_filter import host_of

MIN_PAGES = 8
MIN_SHARE = 0.1
#: So many make a template on a host of any size.
ENOUGH = 40
#: Templates of pages that are joined by broadcast, counted in bytes; more by a shuffle.
BROADCAST_BYTES = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that an open paragraph around them does not reach into.
NO_P = frozenset("button td th caption table".split())
#: For a start tag: the open elements that it ends, and those that it does not reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: What is no article text, by tag, by role and by the words of class and id.
NOT_TEXT = frozenset(
    "head nav footer aside form script style xmp iframe noembed noframes noscript template button select input textarea title dialog svg math canvas object embed audio video menu map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar social share sharing related recommended recommendations comment comments commentlist reply "
    "replies respond disqus discussion widget toolbar pagination pager login paywall skip".split()
)
#: Parts that say nothing of their own beside such a word; parts of one or two letters and sizes do not either.
BESIDE = frozenset(
    "area articles bar block body bottom box btn button buttons card center col column columns container content count cta default desktop feed fixed follow form global google group header holder "
    "horizontal icon icons inner inline item items large leaderboard left line link links list lists main medium middle mobile module more outer page panel policy post posts primary rectangle right row "
    "secondary section site skyscraper slot small sticky stories text thread title tools top unit vertical wrap wrapper zone".split()
)
#: Class names of a site's header; one that holds the first h1 stays.
HEADERS = frozenset("header site-header page-header main-header global-header top-header".split())
#: Containers: what a site repeats is one of these; inside the article they stay.
CONTAINERS = frozenset("div section aside nav footer header form table ul ol dl menu figure details center".split())

_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>"']|$)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript object script style template title".split())


class Node:
    __slots__ = ("tag", "marks", "away", "heads", "children", "parent", "hash", "inside", "words", "paragraph")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.marks = tag, parent, [], ""
        self.away, self.heads, self.hash, self.inside, self.words = False, False, 0, False, 0
        #: the open paragraph that a block's start tag here would end
        self.paragraph = self if tag == "p" else None if tag in NO_P or parent is None else parent.paragraph


_SIZE = re.compile(r"[0-9]*(x[0-9]+)?|.{1,2}")


@functools.lru_cache(maxsize=65_536)
def telling(name: str) -> bool:
    """Does a class or id say that its element is no article text?"""
    parts = _SPLIT.split(_CASE.sub("-", name).lower())
    return any(p in WORDS for p in parts) and all(p in WORDS or p in BESIDE or _SIZE.fullmatch(p) for p in parts)


def _attributes(node: Node, found: str) -> None:
    for m in _ATTR.finditer(found):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            node.marks += f" {name}={value}"
            names = (m[2] or m[3] or m[4] or "").split()
            node.away |= any(map(telling, names))
            node.heads |= not HEADERS.isdisjoint(value.split())
        elif name == "role":
            node.away |= value in ROLES
            node.marks += " main" if value == "main" else ""
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            node.away = True


def parse(page: str) -> list[Node]:
    """All elements of a page in the order of their start tags; the first stands for the page itself."""
    root = Node("", None)
    nodes, now, at, end = [root], root, 0, len(page)
    opened: dict[str, int] = {}

    def close(node: Node, upto: Node) -> Node:
        """Ends the open elements from node up to, and without, upto."""
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            if now.tag == "head" and not page[at:start].isspace():
                now = close(now, now.parent)
            now.children.append(page[at:start])
        if start >= end:
            break
        following = page[start + 1 : start + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 2 if page.startswith("<!-->", start) else start + 4)
                at = end if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", start):
                stop = page.find("]]>", start)
                now.children.append(page[start + 9 : end if stop < 0 else stop].replace("&", "&amp;"))
                at = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            continue
        closing = following == "/"
        name = _NAME.match(page, start + 2 if closing else start + 1)
        if not name:
            if closing:
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                if following:
                    now.children.append("<")
                at = start + 1
            continue
        whole = _TAG_END.match(page, name.end())
        stop = whole.end() if whole else page.find(">", name.end()) + 1
        if not stop:
            break  # the page ends inside a tag
        tag, at = name[0].lower(), stop
        if closing:
            if opened.get(tag):
                node = now
                while node.tag != tag:
                    node = node.parent
                now = close(now, node.parent)
            continue
        if now.tag == "head" and tag not in IN_HEAD:
            now = close(now, now.parent)
        if tag in ENDS_P and now.paragraph is not None:
            now = close(now, now.paragraph.parent)
        if tag in IMPLIED and any(opened.get(t) for t in IMPLIED[tag][0]):
            ends, bound = IMPLIED[tag]
            node, last = now, None
            while node is not root and node.tag not in bound:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                now = close(now, last.parent)
        node = Node(tag, now)
        if stop - name.end() > 1:
            _attributes(node, page[name.end() : stop - 1])
        now.children.append(node)
        nodes.append(node)
        if tag in RAW:
            last = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, stop)
            stop = page.find(">", last.end()) if last else -1
            at = end if stop < 0 else stop + 1
        elif tag not in VOID and page[stop - 2 : stop] != "/>" or tag in BLOCK and tag != "hr":
            now = node
            opened[tag] = opened.get(tag, 0) + 1
    return nodes


def _mark(nodes: list[Node]) -> None:
    """Subtree hashes and words, and whether an element holds a main, an article or a first heading."""
    for node in reversed(nodes):
        parts = [node.tag, node.marks]
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                parts.append(" ".join(words))
                node.words += len(words)
            else:
                node.words += c.words
                parts.append(str(c.hash))
                node.inside |= c.inside or c.tag in ("main", "article", "h1") or " main" in c.marks
        node.hash = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _own(nodes: list[Node]) -> set[int]:
    """The elements of the article: below main, article or the element that holds the first h1 with text, and after it."""
    first = next((i for i, n in enumerate(nodes) if n.tag == "h1" and n.words), len(nodes))
    holder = nodes[first].parent if first < len(nodes) else None
    if holder is not None and holder.tag in ("", "html", "body"):
        holder = None  # what stands before the heading is not yet the article
    own: set[int] = set()
    for i, n in enumerate(nodes):
        if i > first or n is holder or n.tag in ("main", "article") or " main" in n.marks or id(n.parent) in own:
            own.add(id(n))
    return own


def read(page: str) -> list[Node]:
    nodes = parse(page)
    _mark(nodes)
    return nodes


def containers(nodes: list[Node]) -> list[int]:
    """Hashes of the containers with text outside the article that hold no main, article or first heading."""
    own = _own(nodes)
    return sorted({n.hash for n in nodes if n.tag in CONTAINERS and not n.inside and n.words and id(n) not in own})


def main_text(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    return text_of(read(page), templates)[0]


def _is_main(n: Node) -> bool:
    return n.tag == "main" or " main" in n.marks


def _around(nodes: list[Node]) -> set[int]:
    """The elements that the main text lies in."""
    found = [n for n in nodes if _is_main(n)] or [n for n in nodes if n.tag == "article" and not n.away]
    if found:
        up, least = max(found, key=lambda n: n.words), 0
    else:
        up, least = next((n for n in nodes if n.tag == "h1" and n.words), None), nodes[0].words // 2 + 1
    out: set[int] = set()
    while up is not None:
        if up.words >= least:
            out.add(id(up))
        up = up.parent
    return out


def text_of(nodes: list[Node], templates: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
    """The text, and how many subtrees went as templates."""
    kept = _own(nodes) if templates else set()
    around = _around(nodes)
    gone: set[int] = set()
    in_article: set[int] = set()
    tops: list[Node] = []
    counted = 0
    for n in nodes:
        p = id(n.parent)
        if p in in_article or n.tag in ("article", "main"):
            in_article.add(id(n))
        if p in gone:
            gone.add(id(n))
        elif n.tag in CONTAINERS and not n.inside and n.hash in templates and id(n) not in kept:
            counted += 1
            gone.add(id(n))
        elif (
            (n.tag in NOT_TEXT and not (n.tag == "form" and id(n) in around))
            or (n.away and id(n) not in around and n.tag not in ("body", "html"))
            or (p not in in_article and (n.tag == "header" or n.heads and not n.inside))
        ):
            gone.add(id(n))
        elif _is_main(n) or n.tag == "article":
            tops.append(n)
    tops = tops or nodes[:1]
    chosen = {id(n) for n in tops}
    blocks: list[str] = []
    own: list[str] = []

    def flush() -> None:
        text = " ".join("".join(own).split())
        if text:
            blocks.append(text)
        own.clear()

    for top in tops:
        up = top.parent
        while up is not None and id(up) not in chosen:
            up = up.parent
        if up is not None:
            continue
        flush()
        stack: list = [top]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                own.append(html.unescape(n) if "&" in n else n)
            elif id(n) not in gone:
                if n.tag == "br":
                    own.append(" ")
                    continue
                if n.tag in BLOCK or n.tag == "":
                    flush()
                    stack.append(None)
                stack.extend(reversed(n.children))
        flush()
    return "\n".join(blocks), counted


def extract(
    df: DataFrame, page: str = "html", url: str = "url", text: str = "text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH, templates: str | None = None
) -> DataFrame:
    """df with the main text of each page and, if a name for it is given, how many subtrees went as templates."""
    ship(df.sparkSession)
    new = [T.StructField(text, T.StringType()), *([T.StructField(templates, T.LongType())] if templates else [])]
    keep = [f for f in df.schema.fields if f.name not in (text, templates)]
    names = [f.name for f in keep]
    host, one, two, subs, source = free(names, "host", "one", "two", "subs", "page")
    moved = [] if page in names else [F.col(page).alias(source)]
    source = source if moved else page
    whole = F.coalesce(F.col(page), F.lit(""))
    own = df.select(*names, host_of(url).alias(host), F.xxhash64(whole).alias(one), F.xxhash64(whole, F.lit(1)).alias(two), *moved)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("html")
        for batch in it:
            found, articles = [], []
            for p in batch.column(3).to_pylist():
                nodes = read(p) if p else []
                found.append(containers(nodes))
                articles.append(xxhash.xxh3_128_digest(text_of(nodes)[0].encode("utf-8", "surrogatepass") if nodes else b""))
            columns = [*(batch.column(n) for n in range(3)), pa.array(articles, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "one", "two", "article", "subs"])

    seen = own.select(F.col(host).alias("host"), F.col(one).alias("one"), F.col(two).alias("two"), F.col(source).alias("page")).mapInArrow(count, "host string, one long, two long, article binary, subs array<long>")
    seen = cut(seen.select("host", "one", "two", "article", F.explode_outer("subs").alias("sub")).distinct(), "subtrees")
    pages = seen.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = seen.filter("sub IS NOT NULL").select("host", "sub", "article").distinct()
    often = often.groupBy("host", "sub").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = cut(often.join(pages, "host").filter((F.col("n") >= F.col("pages") * min_share) | (F.col("n") >= enough)).select("host", "sub"), "often")
    if often.isEmpty():
        joined = own.withColumn(subs, F.lit(None).cast("array<long>"))
    else:
        marked = seen.join(often, ["host", "sub"]).groupBy("host", "one", "two").agg(F.collect_set("sub").alias(subs))
        marked = cut(marked.withColumnsRenamed({"host": host, "one": one, "two": two}), "marked")
        rows, held = marked.agg(F.count("*"), F.coalesce(F.sum(100 + F.length(host) + 8 * F.size(subs)), F.lit(0))).first()
        joined = own.join(F.broadcast(marked) if rows and held <= BROADCAST_BYTES else marked, [host, one, two], "left")
    drop(seen, often)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("html")
        for batch in it:
            texts, marks = batch.column(source).to_pylist(), batch.column(subs).to_pylist()
            found = [text_of(read(p), frozenset(s or ())) if p else ("", 0) for p, s in zip(texts, marks, strict=True)]
            made = [pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())][: len(new)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, *(f.name for f in new)])

    return joined.select(*names, *([source] if moved else []), subs).mapInArrow(run, T.StructType([*keep, *new]))
