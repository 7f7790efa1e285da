"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is the path of (tag, class, id) from the root. For
each node it is counted, over the host's distinct pages, which child layouts (presentation) and which texts
(content) occur; a page that a host repeats counts once, so copies don't make an article template. The entropy of those counts, with the number of occurrences as base, is the node's
importance: a node that always looks and reads the same tells nothing and is template. A branch of a page is
removed when it and all nodes below it are of low importance, so a wrapper that never varies stays for the
varied text in it. Parts whose tag, role or class names what is no article text are removed as well.
A class or id names such a part by its words alone ("share", "comment-list"), not beside words of
another meaning ("share-price"); an ``article`` only as a reader's comment.

The article is what stands in ``article`` elements, else in ``main``, else in the body. Inside it only
container branches can be removed by importance; running text (headings, paragraphs, lists, quotes) of
the article itself stays, however often a site repeats it.

Defined results: a null or empty page has an empty text; markup that is not closed runs to the end of
the element around it; a null or odd URL belongs to the host "", whose pages are one site; repeated rows
give a row each and count once; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm.id_filter import listed, unlisted
from flowledger.session import materialize

#: A branch is template when a host has it at least so often and its importance is below the threshold.
LEAST_SEEN = 5
LEAST_IMPORTANCE = 0.1

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
#: Never text of an article.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option input textarea iframe object embed svg canvas "
    "dialog menu noembed noframes audio video map datalist fieldset search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Words of a class or id that name such a part.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar side aside widget widgets cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus related "
    "recommended recommendations pagination pager toolbar masthead skip".split()
)
#: Words that only place or shape a part: they don't change what the words beside them name.
SHAPE_WORDS = frozenset(
    "area articles bar block body bottom box button buttons column content container footer form group header holder icons inner item items left links list "
    "main page panel post posts primary region right rail row secondary section site slot stories thread title top unit wrap wrapper zone".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: With one of these, such a word tells of the page's layout: "has-sidebar", "no-ads".
LAYOUT_WORDS = frozenset("has with without no layout".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre b i em strong a span br code figure figcaption img hr q cite sub sup small u s".split())
#: Elements that close an open paragraph, and those an opening tag of the same kind closes.
CLOSES_P = BLOCK - {"br", "button", "body", "head", "html", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "template"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select",))}

TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    __slots__ = ("tag", "name", "path", "dropped", "children", "running", "said")

    def __init__(self, tag: str, name: str, path: int, dropped: bool, running: bool):
        self.tag, self.name, self.path, self.dropped, self.running = tag, name, path, dropped, running
        self.children: list[str] = []
        self.said: list[str] = []


@lru_cache(maxsize=100_000)
def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _names_part(tag: str, marks: list[str]) -> bool:
    """Whether a class or the id names a part that is no article text."""
    named = [set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", mark).lower())) for mark in " ".join(marks).split()]
    telling = COMMENT_WORDS if tag == "article" else DROPPED_WORDS
    if tag in ("html", "body", "main") or any(words & LAYOUT_WORDS for words in named):
        return False
    return any(words & telling and words <= DROPPED_WORDS | SHAPE_WORDS for words in named)


@lru_cache(maxsize=20_000)
def _element(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Name of a node in the style tree, whether it is never article text, and whether it is plain running text."""
    if not attrs.strip(" /\n\t\r\f"):
        return tag, tag in DROPPED, tag in RUNNING
    got = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attrs)}
    marks = [got.get("class", ""), got.get("id", "")]
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", ""))
    dropped = tag in DROPPED or got.get("role", "").lower() in DROPPED_ROLES or bool(hidden) or _names_part(tag, marks)
    return f"{tag}.{' '.join(sorted(marks[0].split()))}#{marks[1]}", dropped, tag in RUNNING and not any(marks)


def walk(page: str) -> Iterator[tuple[str, Node, list[Node], str]]:
    """Events of a page: ("text", parent, stack, text), ("open" | "close", node, stack, "")."""
    stack = [Node("", "", 0, False, False)]

    def close(to: int):
        while len(stack) > to:
            node = stack.pop()
            yield "close", node, stack, ""

    def open_at(tags, scope=frozenset()) -> int:
        """Place of the innermost open element of ``tags`` within ``scope``, or the stack's length."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in scope:
                break
        return len(stack)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if m["text"] == "<" and re.match("/?[a-zA-Z]", page[at : at + 2]):  # a quote that never ends: the tag ends at the next sign that can end one
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if m["text"]:
            yield "text", stack[-1], stack, m["text"]
            continue
        if m["tag"] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", stack[-1], stack, m[0][9:-3]
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br" or tag == "p" and open_at(("p",)) == len(stack):
                yield "open", Node(tag, tag, 0, False, True), stack, ""
            elif tag not in VOID:
                yield from close(open_at((tag,)))
            continue
        if tag in CLOSES_P:
            yield from close(open_at(("p",), frozenset(("button", "td", "th", "article", "section", "div", "li"))))
        if tag in CLOSES:
            yield from close(open_at(CLOSES[tag], SCOPES[tag]))
        name, dropped, running = _element(tag, m["attrs"])
        parent = stack[-1]
        parent.children.append(name)
        node = Node(tag, name, _key(f"{parent.path}/{name}"), dropped, running)
        yield "open", node, stack, ""
        if tag in VOID or m["attrs"].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            stop, after = (end.start(), end.end()) if end else (size, size)
            if tag not in DROPPED:
                stack.append(node)
                yield "text", node, stack, page[at:stop]
                yield from close(len(stack) - 1)
            at = after
            continue
        stack.append(node)
    yield from close(1)


def features(page: str) -> Iterator[tuple[int, str, int]]:
    """What a page adds to the style tree: (node, "style" | "text", key of its child layout or of its own text)."""
    for what, node, stack, text in walk(page):
        if what == "text":
            if text.strip():
                node.said.append(text)
        elif what == "close" and not node.dropped and not node.running:
            said = " ".join(" ".join(node.said).split())
            yield node.path, "style", _key(" ".join(dict.fromkeys(node.children)))
            yield node.path, "text", _key(said) if said else 0
        elif what == "close" and node.running:
            # running text counts as text of the container that holds it
            stack[-1].said.extend(node.said)


def extract(page: str, removed: frozenset[int] = frozenset()) -> str:
    """The article's text: blocks in page order, joined by a space."""
    found: dict[str, list[str]] = {"article": [], "main": [], "body": []}
    block: list[str] = []
    where = None

    def flush():
        nonlocal block
        if block and (said := " ".join(entities.unescape("".join(block)).split())):
            for kind in where:
                found[kind].append(said)
        block = []

    off = 0  # open elements that are no article text
    inside: Counter = Counter()
    places = lambda: ("body", *(k for k in ("article", "main") if inside[k]))
    where = places()
    low: list[list] = []  # open nodes of low importance: node, sizes of ``found`` before it, whether a node below it is not low
    for what, node, stack, text in walk(page):
        if what == "text":
            if not off:
                block.append(text)
            continue
        opens = what == "open" and node.tag not in VOID and node.path
        change = 1 if opens and node.tag not in RAW else -1 if what == "close" and node.path else 0
        if not off and (node.tag in BLOCK or node.dropped and node.tag not in RAW):
            flush()
        if node.dropped:
            off += change if node.tag not in RAW else 0
            continue
        if off:
            continue
        if node.tag in ("article", "main"):
            inside[node.tag] += change
            where = places()
        if not change:
            continue
        template = node.path in removed and not (node.running and inside["article"]) and node.tag not in ("html", "body", "main", "article")
        if what == "close" and low and low[-1][0] is node:
            flush()
            _, sizes, telling = low.pop()
            if not telling:
                for kind, size in sizes.items():
                    del found[kind][size:]
            elif low:
                low[-1][2] = True
        elif what == "open" and template:
            flush()
            low.append([node, {kind: len(said) for kind, said in found.items()}, False])
        elif what == "open" and low and not node.running:
            low[-1][2] = True
    flush()
    return " ".join(next((x for x in (found["article"], found["main"], found["body"]) if x), []))


# -- as Spark jobs -----------------------------------------------------------------------------------


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        rows = [(h, p, k, x, n) for (h, p, k, x), n in counts.items()]
        cols = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "node", "kind", "key", "n"])
        counts.clear()

    for batch in batches:
        for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
            h = host.as_py()
            counts.update((h, *f) for f in features(page.as_py()))
            if len(counts) > 200_000:
                yield from out()
    if counts:
        yield from out()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, html of each distinct page of a host. Only pages whose hash occurs again are shuffled."""
    hashed = pages.select("host", "html", F.xxhash64("host", "html").alias("page"))
    again = materialize(hashed.groupBy("page").count().filter("count > 1").select("page"), "repeated-pages")
    copies = listed(hashed, again, "page").dropDuplicates(["page", "host", "html"])
    return unlisted(hashed, again, "page").unionByName(copies).select("host", "html")


def node_importance(pages: DataFrame) -> DataFrame:
    """Per (host, node): seen, and its importance, the larger of both entropies on a scale from 0 to 1."""
    counted = distinct_pages(pages).mapInArrow(_count_features, "host string, node long, kind string, key long, n long")
    by_key = counted.groupBy("host", "node", "kind", "key").agg(F.sum("n").alias("n"))
    by_kind = by_key.groupBy("host", "node", "kind").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("inner"))
    entropy = F.when(F.col("seen") > 1, (F.log("seen") - F.col("inner") / F.col("seen")) / F.log("seen")).otherwise(1.0)
    return by_kind.groupBy("host", "node").agg(F.max("seen").alias("seen"), F.max(entropy).alias("importance"))


def main_text(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_seen: int = LEAST_SEEN,
    least_importance: float = LEAST_IMPORTANCE,
) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    )
    template = node_importance(rows).filter((F.col("seen") >= least_seen) & (F.col("importance") < least_importance))
    # Stored, so that the join to the pages knows its true size: a small one spares the pages a shuffle.
    removed = materialize(template.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("removed")), "template-nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), frozenset(r.as_py() or ())) for p, r in zip(batch.column("html"), batch.column("removed"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(removed, "host", "left").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
