"""Operator 9: main text of HTML pages, with site templates removed.

A page is read as a tree of its block elements (inline tags only pass their text on).
Each element's subtree is hashed twice: with its text, and as a frame, that is its path
and the shape of its subtree (tags and classes; equal neighbours count once) without
text. Spark counts on how many different pages of a host, and of a section of it
(the first part of the path), each hash occurs; pages of equal text count once, so that mirrored
articles are no template. On at least ``LEAST`` pages and a share of ``SHARE`` of the
host's or section's pages a hash is template, and such subtrees are deleted:

- by text, wherever they are; inside the page's content element only at a share of ``INNER`` of the host's pages;
- by frame, where they stand beside the way from the body down to the content element (the
  one article or main element, else the innermost that holds half of the text), or are mostly links. So a menu, an
  advert or a notice whose words change from page to page goes too. A frame that is the
  content's on other pages stays.

What is left loses elements whose markup names a role, by tag, role attribute or one
whole class or id (nav, footer, aside, form, class "ad" or "comments"); this is all that a host of few pages
has. If article or main elements with text remain, only those are read.

A template has at most (mean subtrees of a page) / SHARE hashes for the host and as many for the
section, so one array holds it. Pages are joined with it: by broadcast where Spark
finds that table small, else by a shuffle whose hot hosts AQE splits. Counting aggregates
before it shuffles, so a host with a third of all pages costs one row per hash and task.

Cases: null or empty html gives an empty text; a null or odd url has the host "", whose
pages are compared like any host's. Unclosed, stray and misnested tags never fail: an
end tag closes the nearest open element of its name, p, li and table cells end where
the next one starts. An unfinished tag at the end is no text; an unfinished script, style,
title or textarea hides the rest, as in browsers. Time grows with the page's length only.
Repeated rows give repeated results. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import stage

LEAST = 5
SHARE, INNER = 0.2, 0.5
#: A content element holds this share of the page's text; a list of links, this share in links.
MOST = 0.5

ATTRIBUTES = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "html body head main article section nav header footer aside form div p ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary fieldset dialog menu center hgroup search button label"
    " svg select canvas video audio noscript template datalist".split()
)
CONTAINERS = frozenset("html body main article section nav header footer aside form div ul ol dl table menu center details dialog fieldset address".split())
WHOLE = frozenset(["", "html", "body"])
BREAKS = frozenset(["br", "hr"])
#: Elements that end where one of the named starts, unless one of the bounds is nearer.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}
ASIDE = frozenset("nav footer aside form head dialog menu button label search fieldset svg select canvas video audio noscript template datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments comment-list commentlist disqus disqus_thread reply replies respond".split())
ASIDE_WORDS = COMMENTS | frozenset(
    "ad ads advert advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " widget pagination pager toolbar".split()
)


class Node:
    __slots__ = ("tag", "named", "out", "main", "parts", "hash", "frame", "size", "links", "gone")

    def __init__(self, tag: str, named: str = "", out: bool = False):
        self.tag, self.named, self.out, self.main = tag, named, out, tag in ("article", "main")
        self.parts: list = []  # texts, breaks (None) and nodes in order
        self.hash = self.frame = self.size = self.links = 0
        self.gone = False

    def below(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def node_of(tag: str, attributes: str, inside_main: bool) -> Node:
    """The element; out tells whether its markup gives it a role beside the main text."""
    named, out, main = "", tag in ASIDE or tag == "header" and not inside_main, tag in ("article", "main")
    if "=" in attributes:
        for key, a, b, c in NAMED.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key != "id":
                named += f" {key}={re.sub('[0-9]+', '0', value)}"
            if key == "role":
                out = out or value in ROLES
                main = main or value == "main"
            else:
                out = out or not (COMMENTS if main else ASIDE_WORDS).isdisjoint(value.split())
    node = Node(tag, named, out and tag not in WHOLE)
    node.main = main
    return node


def parse(page: str) -> Node:
    """The tree of the page's block elements."""
    root = Node("")
    stack, depths = [root], defaultdict(list)
    at, end, last = 0, len(page), page.rfind(">")
    in_link, in_main, hidden = 0, 0, set()

    def close(depth: int) -> None:
        nonlocal in_main
        while len(stack) > depth:
            x = stack.pop()
            depths[x.tag].pop()
            in_main -= x.main

    def add(text: str) -> None:
        here = stack[-1]
        here.parts.append(text)
        n = len(text) - text.count(" ")
        here.size += n
        here.links += n * in_link

    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            stop = -1 if "--" in hidden else page.find("-->", start + 4)
            if stop < 0:
                hidden.add("--")
                break
            at = stop + 3
            continue
        m = NAME.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                if start > last:
                    break
                at = page.find(">", start) + 1
            else:
                add("<")
                at = start + 1
            continue
        if start > last:
            break
        whole = ATTRIBUTES.match(page, m.end())
        at = whole.end() if whole else page.find(">", m.end()) + 1
        tag, attributes = m[0].lower(), page[m.end() : at - 1]
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                if depths[tag]:
                    close(depths[tag][-1])
                else:
                    stack[-1].parts.append(None)
        elif tag == "a":
            in_link = 1
        elif tag in BREAKS:
            stack[-1].parts.append(None)
        elif tag in RAW:
            if attributes.endswith("/") and depths["svg"]:
                continue
            found = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if found is None:
                break
            at = found.end()
        elif tag in BLOCKS:
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag in CLOSED_BY:
                same, bounds = (max((depths[t][-1] for t in names if depths[t]), default=0) for names in CLOSED_BY[tag])
                if same > bounds:
                    close(same)
            node = node_of(tag, attributes, in_main > 0)
            stack[-1].parts.append(node)
            if not (tag == "svg" and attributes.endswith("/")):
                depths[tag].append(len(stack))
                stack.append(node)
                in_main += node.main
    return root


def tidy(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def nodes(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.below()
    return out


def digest(*pieces) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, pieces)).encode("utf-8", "surrogatepass")) - (1 << 63) or 1


def hash_tree(root: Node) -> list[Node]:
    """Sets every node's hash, frame, size and links; returns the nodes that have text somewhere below, parents first."""
    every = nodes(root)
    shape: dict[int, int] = {}
    for x in reversed(every):
        pieces, outline, some = [x.tag, x.named], [], False
        for p in x.parts:
            if isinstance(p, Node):
                pieces.append(str(p.hash))
                some = some or p.hash != 0
                x.size, x.links = x.size + p.size, x.links + p.links
                if not outline or outline[-1] != shape[id(p)]:
                    outline.append(shape[id(p)])
            elif p is not None and (t := tidy(p)):
                pieces.append(t)
                some = True
        shape[id(x)] = digest(x.tag, x.named, *outline)
        x.hash = digest(*pieces) if some else 0
    path = {id(root): 0}
    for x in every:
        own = path[id(x)]
        x.frame = digest("frame", own, shape[id(x)])
        for p in x.below():
            path[id(p)] = digest(own, x.tag, x.named)
    return [x for x in every if x.hash]


def way_in(root: Node) -> list[Node]:
    """The elements from the root down to the content element: the one article or main element, else each holds most of the page's text."""
    above, todo = {}, [root]
    named = []
    while todo:
        x = todo.pop()
        if x.main and not x.out:
            named.append(x)
        else:
            above |= {id(p): x for p in x.below()}
            todo += x.below()
    if len(named) == 1:
        path = named
        while path[-1] is not root:
            path.append(above[id(path[-1])])
        return path[::-1]
    path = [root]
    while not path[-1].main:
        inner = [p for p in path[-1].below() if p.tag in CONTAINERS and p.size >= MOST * root.size]
        if not inner or not root.size:
            break
        path.append(max(inner, key=lambda p: p.size))
    return path


def slots(path: list[Node]) -> list[Node]:
    """The containers beside the way in, and those in the content, outside article and main, that are mostly links."""
    on_way = set(map(id, path))
    out = [p for x in path[:-1] for p in x.below() if p.tag in CONTAINERS and id(p) not in on_way]
    todo = [] if path[-1].main else path[-1].below()
    while todo:
        x = todo.pop()
        if x.tag in CONTAINERS and x.size and x.links >= MOST * x.size:
            out.append(x)
        elif not x.main:
            todo += x.below()
    return out


def content(path: list[Node]) -> set[int]:
    """What stands in the content element; nothing where that is the page itself."""
    return set() if path[-1].tag in WHOLE else set(map(id, nodes(path[-1])))


def marks(root: Node) -> tuple[int, set[int]]:
    """The hash of the whole page (0 without text), and all hashes that are counted."""
    full = hash_tree(root)
    if not full:
        return 0, set()
    path = way_in(root)
    out = {x.hash for x in full if x.tag not in WHOLE}
    out |= {x.frame for x in slots(path) if x.hash}
    return root.hash, out | {~x.frame for x in path}


def drop_template(root: Node, often: set[int], always: set[int]) -> None:
    """Marks the nodes that are template as gone."""
    full = hash_tree(root)
    path = way_in(root)
    inner = content(path)
    for x in full:
        x.gone = x.tag not in WHOLE and x.hash in (always if id(x) in inner else often)
    for x in slots(path):
        x.gone = x.gone or x.frame in often and ~x.frame not in often


def blocks(root: Node, roles: bool) -> list[str]:
    """The texts of the blocks in page order, without what is gone or, with roles, out."""
    out: list[str] = []
    held: list[str] = []

    def end():
        if held and (t := tidy("".join(held))):
            out.append(t)
        held.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not (x.gone or x.tag in ("head", "svg", "select", "template", "datalist") or roles and x.out):
            todo += [None, *reversed(x.parts), None]
    end()
    return out


def mains(root: Node) -> list[Node]:
    """The outermost article and main elements that are not out."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.out or x.gone:
            continue
        if x.main:
            out.append(x)
        else:
            todo += reversed(x.below())
    return out


def main_text(page: str | None, often=(), always=(), roles: bool = True) -> str:
    """The page's text without its template (hashes often and always); roles False leaves the template alone to decide."""
    if not page:
        return ""
    root = parse(page)
    if often:
        drop_template(root, set(often), set(always or ()))
    found = [b for m in mains(root) for b in blocks(m, roles)] if roles else []
    return " ".join(found or blocks(root, roles))


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), HOST, 1), F.lit("")))


def section(url: str = "url"):
    """The first part of the path, where more follows."""
    return F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def subtrees(df: DataFrame) -> DataFrame:
    """(host, section, page, hash) of every page's different hashes; page tells pages by their text."""

    def run(batches):
        for batch in batches:
            rows: list = [[], [], [], []]
            for h, s, page in zip(batch.column(0), batch.column(1), batch.column(2)):
                whole, own = marks(parse(page.as_py() or ""))
                for column, v in zip(rows, ([h.as_py()] * len(own), [s.as_py()] * len(own), [whole] * len(own), own)):
                    column += v
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["host", "section", "page", "hash"])

    return df.select("host", "section", "html").mapInArrow(run, "host string, section string, page long, hash long")


def shares(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hash, share): the hashes on at least LEAST different pages and SHARE of those of the keys."""
    rows = found.select(*keys, "page", "hash").distinct()
    pages = rows.select(*keys, "page").distinct().groupBy(*keys).agg(F.count("*").alias("pages"))
    counts = rows.groupBy(*keys, "hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    return counts.join(pages, keys).withColumn("share", F.col("n") / F.col("pages")).where(F.col("share") >= SHARE).select(*keys, "hash", "share")


def templates(pages: DataFrame) -> DataFrame:
    """(host, section, often array<long>, always array<long>) of sections with a template; pages: (host, section, html)."""
    found = stage(subtrees(pages), "subtrees")
    sections = found.select("host", "section").distinct()
    by_host = sections.join(shares(found, ["host"]), "host").select("host", "section", "hash", "share")
    both = by_host.unionByName(shares(found, ["host", "section"]).withColumn("share", F.lit(0.0)))
    return both.groupBy("host", "section").agg(F.collect_set("hash").alias("often"), F.collect_set(F.when(F.col("share") >= INNER, F.col("hash"))).alias("always"))


def extract(df: DataFrame, roles: bool = True) -> DataFrame:
    """(page_id, url, text) of every row of df (page_id, url, html)."""
    pages = df.select("page_id", "url", "html").withColumns({"host": host(), "section": section()})
    known = stage(templates(pages), "templates")
    joined = pages.join(known, ["host", "section"], "left").select("page_id", "url", "html", "often", "always")

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), o.as_py() or (), a.as_py() or (), roles) for h, o, a in zip(batch.column(2), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, StructType([*joined.schema.fields[:2], *StructType.fromDDL("text string").fields]))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op9_html": op9_html}
