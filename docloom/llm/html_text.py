"""Main text of web pages, with site templates removed.

First pass: the subtree of every block element, whatever its tag or class says, is hashed (its tags and normalised text,
without attributes that vary), and Spark counts on how many pages of one host, alike pages once, each hash stands. A
subtree on many pages of one host is part of that site's template. Second pass: template subtrees are deleted. What is
left and occurs on few pages is judged by what its tag, role or class says (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments), and the rest becomes text: that of all articles of the page, or of the
whole page where no element says that it is one. Inside an `article` or `main` element a repeated heading or paragraph is
prose that several pages carry, so only non-prose subtrees are deleted there.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
#: A tag whose quotes are closed, and one that ends at the next ">" whatever its quotes say. Neither gives back what it took.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Fixed sets of HTML element names, by what the HTML standard says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOT_TEXT = frozenset("script style noscript template iframe noembed noframes xmp head title nav footer aside form button select textarea input dialog svg canvas object audio video map menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th".split())
#: Words of a class, id or role that mark an element as something other than the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|footer|site-?header|masthead|topbar|"
    r"cookies?|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe\w*|share\w*|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|discussion|pagination|pager|search|login|signup|skip-link|"
    r"complementary|contentinfo|alertdialog)(?:$|[\s_-])",
    re.I,
)
ROLE_HEADER = re.compile(r"(?:^|[\s_-])(?:header)(?:$|[\s_-])", re.I)


def host_of(url: str | None) -> str:
    """Host of a URL in lower case; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Node:
    """An element: its name, whether it is kept out of the text, its children (strings and nodes), and its depth in prose."""

    __slots__ = ("children", "name", "out")

    def __init__(self, name: str, out: bool):
        self.name, self.out, self.children = name, out, []


BARRIERS = frozenset("article main body td table".split())


class _Open:
    """The open elements, with their places by name, so that a close tag finds its own at once."""

    def __init__(self, root: Node):
        self.stack, self.places, self.barriers = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.stack))
        if node.name in BARRIERS:
            self.barriers.append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        name = self.stack.pop().name
        self.places[name].pop()
        if name in BARRIERS:
            self.barriers.pop()

    def close(self, name: str) -> None:
        """Close the innermost element of a name and all within it; one of prose only inside the innermost article or cell."""
        own = self.places[name]
        if not own or name in INLINE | PROSE and self.barriers and self.barriers[-1] > own[-1]:
            return
        for _ in range(len(self.stack) - own[-1]):
            self.pop()


def parse(page: str) -> Node:
    """The page as a tree. Unclosed and misnested elements are closed as browsers do in the common cases.

    The time is in proportion to the page: no part of it is looked at again after a tag was not found there. Where a quote
    in a tag is never closed, from there on tags end at the next ">"; what follows the last ">" is text.
    """
    root = Node("", False)
    open_now, at, end, last, tag = _Open(root), 0, len(page), page.rfind(">"), TAG
    while at < end:
        m = OPEN.search(page, at)
        i = m.start() if m else end
        kind = m[0] if m else ""
        if kind not in ("<!--", "<![CDATA[") and i > last:
            i = end
        if i > at:
            open_now.stack[-1].children.append(page[at:i])
        if i == end:
            break
        if kind in ("<!--", "<![CDATA["):
            close = "-->" if kind == "<!--" else "]]>"
            found = page.find(close, i + len(kind))
            at = found + len(close) if found >= 0 else end
            continue
        if kind in ("<!", "<?"):
            at = page.find(">", i) + 1
            continue
        m = tag.match(page, i)
        if m is None:
            tag = LOOSE_TAG
            m = tag.match(page, i)
        at = m.end()
        name = m[2].lower()
        if m[1]:
            open_now.close(name)
            continue
        stack = open_now.stack
        if name in CLOSES_P:
            while len(stack) > 1 and (stack[-1].name == "p" or stack[-1].name in INLINE and open_now.places["p"]):
                open_now.pop()
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1].name == name:
            open_now.pop()
        node = Node(name, name in NOT_TEXT or _marked(name, m[3]))
        stack[-1].children.append(node)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        open_now.push(node)
    return root


def _marked(name: str, attributes: str) -> bool:
    if not attributes or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role", "aria-label") and name not in ("article", "main", "p", "h1", "h2", "h3", "b", "i") and (MARKS.search(value) or name != "article" and ROLE_HEADER.search(value)):
            return True
    return False


def subtree_hashes(root: Node, host: str = "") -> tuple[dict[int, int], int]:
    """id(node) to a hash of its host and subtree, for all block elements with text; and the hash of the whole page."""
    found: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if type(c) is Node]
    text: dict[int, str] = {}
    for node in reversed(order):  # children before parents
        parts = [text.get(id(c), "") if type(c) is Node else " ".join(c.split()) for c in node.children]
        inner = " ".join([p for p in parts if p])
        digest = inner if len(inner) <= 64 else f"#{xxhash.xxh3_128_hexdigest(inner)}"
        text[id(node)] = f"<{node.name}>{digest}" if inner else ""
        if inner and node.name and node.name not in INLINE and node.name not in ("html", "head", "body", "article", "main"):
            found[id(node)] = signed(xxhash.xxh64_intdigest(f"{host} {text[id(node)]}"))
    return found, signed(xxhash.xxh64_intdigest(text[id(root)]))


def content_roots(root: Node) -> list[Node]:
    """The outermost articles outside what is left out; the outermost `main` elements if there are none, or if the
    articles hold less than half of their text; the whole page if there is neither."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    for name, tops in found.items():
        todo = [root]
        while todo:
            node = todo.pop()
            if node.out:
                continue
            if node.name == name:
                tops.append(node)
            else:
                todo += [c for c in reversed(node.children) if type(c) is Node]
    size = {name: sum(len(t) for top in tops for t in _strings(top, frozenset(), {}, True)) for name, tops in found.items()}
    if found["article"] and 2 * size["article"] >= size["main"]:
        return found["article"]
    return found["main"] or [root]


def _strings(top: Node, template: frozenset[int] | set[int], hashes: dict[int, int], article: bool = False) -> Iterator[str]:
    """Text pieces in page order; '\\n' stands for the edge of a block."""
    todo: list = [top]
    while todo:
        x = todo.pop()
        if type(x) is str:
            yield x
            continue
        if x.out and x is not top or x.name == "header" and not article and x is not top:
            continue
        if x is not top and template and hashes.get(id(x)) in template and not (article and x.name in PROSE):
            continue
        if x.name == "br":
            yield " "
            continue
        block = x.name not in INLINE
        if block:
            yield "\n"
            todo.append("\n")
        todo += reversed(x.children)


def main_text(root: Node, template: set[int] | frozenset[int] = frozenset(), hashes: dict[int, int] | None = None) -> str:
    """Text of the page: character references decoded, white space inside a block one space, blocks joined by one space."""
    pieces = []
    for top in content_roots(root):
        pieces += ["\n", *_strings(top, template, hashes or {}, top is not root)]
    raw = "".join([s if s in ("\n", " ") else html.unescape(s) for s in pieces])
    return " ".join(raw.split())


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def extract(pages: DataFrame, *, min_pages: int = 5, least_pages: int = 3, min_share: float = 0.2, broadcast_limit: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html).

    A subtree is template if it is on `min_pages` pages of its host, alike pages counted once, or, on smaller hosts, on
    `least_pages` pages and `min_share` of all. Null or empty html gives '' and 0; a null url counts as a host of its own
    (''). Repeated rows each give a row; other columns are not read; an empty table gives an empty result. The template
    table goes to the tasks whole, as 8 bytes a row, while it has at most `broadcast_limit` rows; beyond that each page's
    hashes are joined to it and the pages follow by a shuffle on their content key.
    """
    spark = pages.sparkSession
    given = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    template = template_table(given, min_pages, least_pages, min_share)
    page_type, url_type = (given.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    schema = f"page_id {page_type}, url {url_type}, text string, n_chars long"
    if template.count() <= broadcast_limit:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in template.select("hash").toLocalIterator()], np.int64)))

        def chosen(hashes: list[int]) -> set[int]:
            at = np.searchsorted(known.value, hashes)
            return {h for h, i in zip(hashes, at.tolist(), strict=True) if i < len(known.value) and known.value[i] == h}

        return map_batches(given, lambda: lambda batch: _extracted(batch, lambda _, hashes: chosen(list(hashes))), schema)
    key = F.xxhash64("page_id", "url", "html")
    hits = subtree_rows(given.withColumn("key", key)).join(template.select("hash"), "hash").groupBy("key").agg(F.collect_set("hash").alias("hits"))
    joined = given.withColumn("key", key).join(hits, "key", "left").select("page_id", "url", "html", "hits")

    def make_joined():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [set(x or ()) for x in batch.column(3).to_pylist()]
            return _extracted(batch, lambda i, hashes: own[i])

        return step

    return map_batches(joined, make_joined, schema)


def _extracted(batch: pa.RecordBatch, template_of: Callable[[int, set[int]], set[int]]) -> pa.RecordBatch:
    texts = []
    for i, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        root = parse(page)
        hashes, _ = subtree_hashes(root, host_of(url))
        texts.append(main_text(root, template_of(i, set(hashes.values())), hashes))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def subtree_rows(pages: DataFrame) -> DataFrame:
    """host, hash, page, key: one row for each different block subtree of a page (url, html, key), with the hash of the
    whole page; hash null stands for the page itself."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, hashes, whole, keys = [], [], [], []
            for url, page, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                host = host_of(url)
                found, own = subtree_hashes(parse(page), host)
                mine = [None, *set(found.values())]
                hosts += [signed(xxhash.xxh64_intdigest(host))] * len(mine)
                hashes += mine
                whole += [own] * len(mine)
                keys += [key] * len(mine)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (hosts, hashes, whole, keys)], ["host", "hash", "page", "key"])

        return step

    return map_batches(pages.select("url", "html", "key"), make, "host long, hash long, page long, key long")


def template_table(pages: DataFrame, min_pages: int, least_pages: int, min_share: float) -> DataFrame:
    """host, hash, n: the subtrees that recur across the different pages of a host."""
    rows = subtree_rows(pages.withColumn("key", F.lit(0).cast("long")))
    # Alike pages first become one: each sum is by parts, so no host or subtree gathers in one task.
    counts = rows.select("host", "hash", "page").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("n") >= least_pages) | F.col("hash").isNull())
    counts = materialise(counts, "subtrees")
    of_host = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    enough: Column = (F.col("n") >= min_pages) | (F.col("n") >= min_share * F.col("pages"))
    return counts.where("hash is not null").join(of_host, "host").where(enough).select("host", "hash", "n")
