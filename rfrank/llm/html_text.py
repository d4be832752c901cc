"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes; each is content or not. A node's potential comes from its tag and
name class, its link density, its text and its company among its siblings; parent and child are tied by a
two-by-two potential, which depends on whether the child's markup calls it an article. Nodes that their
markup calls a menu, a sidebar, comments and the like are observed: not content, whatever is in them.
Sum-product messages go up the tree and down again, which gives every node's exact marginal; blocks with
a marginal of at least one half are the main text. A page without telling names is decided by the other
features and the messages alone.

Reading a page takes time in proportion to its length, however broken or deep it is.

Labelled pages train both potentials: pages whose own markup names their article (one ``article`` or
``main``) label their nodes, and the potentials are smoothed log ratios of counts, taken in Spark over the
``sample_pages`` different labelled pages that hash lowest. Applying the model is one scan without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, text_of

# HTML's element kinds.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Shown by other means than text, or controls: their text is left out. A block that begins ends the first kind,
#: an article any but a template, and the end of the block around them all.
ENDED = {"select", "svg", "datalist"}
HIDDEN = ENDED | {"button", "canvas", "noscript", "template", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li",
    "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul", "caption",
}
#: What a start tag closes if it is open, and where looking for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"caption"}, {"table"}),
}
P_SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "body"}

# Tags and name words that tell content from the rest.
GOOD_TAGS = {"article", "main"}
BAD_TAGS = {"nav", "footer", "header", "aside", "menu", "dialog", "search"}
GOOD_NAMES = {"article", "content", "post", "entry", "story", "main", "body", "text", "maincontent", "articlebody"}
BAD_NAMES = {
    "ad", "ads", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "footer", "header",
    "masthead", "topbar", "sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "cookie",
    "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "search", "share", "sharing", "social", "comment", "comments", "disqus", "reply", "replies", "respond",
    "copyright", "legal", "disclaimer", "tags", "byline", "hidden", "skip", "navigationbar", "complementary", "contentinfo",
}

#: Words that leave a name's meaning to the others in it.
FILLERS = {
    "site", "main", "top", "bottom", "left", "right", "primary", "secondary", "global", "list", "box", "wrapper", "wrap", "container", "block", "item", "items", "section", "area",
    "links", "link", "bar", "button", "buttons", "form", "posts", "articles", "stories", "inner", "outer", "mobile", "desktop", "sticky", "user", "post", "article", "entry", "icons", "widgets",
    "message", "row", "col", "column", "group", "panel", "title", "heading", "text", "body", "count", "thread", "author", "reader", "media", "js", "el", "module", "component", "slot", "unit", "space",
}

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
# Possessive, so that a tag without an end is given up at once. A quote that does not end is plain.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (*RAW, "head")}
_BODY = re.compile(r"<body(?=[\s/>])", re.I)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_NAME = re.compile(r"[a-z]+")

STRONG, MIDDLE, WEAK = 6.0, 3.0, 1.5  # most that one feature may weigh
STAY = 0.995  # most that a parent may say for its child
FEATURES = (
    "good_tag", "bad_tag", "good_name", "bad_name", "hint_bad", "form", "links_none", "links_some", "links_most", "short", "middle", "long", "stop", "no_stop",
    "is_paragraph", "is_heading", "is_other", "alone", "in_company",
)
#: What kind of block holds a text; any tag else, a division among them, is another.
KINDS = {"p": "is_paragraph", "pre": "is_paragraph", "blockquote": "is_paragraph", "li": "is_item", "dt": "is_item", "dd": "is_item", "td": "is_cell", "th": "is_cell", "caption": "is_cell"} | {f"h{i}": "is_heading" for i in range(1, 7)}
_AT = {f: i for i, f in enumerate(FEATURES)}


class Node:
    __slots__ = ("tag", "parent", "kind", "chars", "linked", "stop", "company")

    def __init__(self, tag: str, parent: int, kind: tuple):
        self.tag, self.parent, self.kind, self.chars, self.linked, self.stop, self.company = tag, parent, kind, 0, 0, False, 0


_kinds: dict[tuple[str, str], tuple] = {}


def _kind(tag: str, attrs: str) -> tuple:
    """The features that tag and attributes give; cached, since templates repeat."""
    found = _kinds.get((tag, attrs))
    if found is None:
        out = set()
        if tag in GOOD_TAGS:
            out.add("good_tag")
        elif tag in BAD_TAGS:
            out.add("bad_tag")
        elif tag in ("form", "fieldset"):
            out.add("form")
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if name == "style":
                hidden = "display:none" in value.replace(" ", "")
            else:
                hidden = name == "hidden" or name == "aria-hidden" and value == "true"
            if hidden:
                out.add("bad_name")
            elif name in ("class", "id", "role") and tag not in ("html", "body"):
                names = [set(_NAME.findall(n)) for n in value.split()]
                # Only a whole name says that its element is not content; a word in a longer name is a hint.
                if any(n <= GOOD_NAMES for n in names if n):
                    out.add("good_name")
                elif any(n & BAD_NAMES and n <= BAD_NAMES | FILLERS for n in names):
                    out.add("bad_name")
                elif any(n & BAD_NAMES for n in names):
                    out.add("hint_bad")
                elif any(n & GOOD_NAMES for n in names):
                    out.add("good_name")
        if "bad_name" in out:
            out.discard("good_name")
        found = tuple(sorted(_AT[f] for f in out))
        if len(_kinds) > 20_000:
            _kinds.clear()
        _kinds[tag, attrs] = found
    return found


class _Stack:
    """The open elements, with where each tag is open."""

    def __init__(self):
        self.tags, self.blocks = ["#root"], [0]
        self.at: dict[str, list[int]] = {}
        self.links = self.hidden = 0

    def push(self, tag: str, block: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.blocks.append(block)
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def last(self, tags) -> int:
        """Where the innermost of some tags is open; 0 if none is."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def outermost_above(self, tags, depth: int) -> int:
        """Where the outermost of some tags is open above ``depth``; 0 if none is."""
        found = (self.at[t][i] for t in tags if self.at.get(t) and (i := bisect_right(self.at[t], depth)) < len(self.at[t]))
        return min(found, default=0)

    def close(self, depth: int) -> bool:
        """Close what is open from ``depth`` on; whether a block was."""
        block = False
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.blocks.pop()
            self.at[tag].pop()
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN
            block |= tag in BLOCK
        return block


def _skip_raw(page: str, tag: str, at: int) -> int:
    """Past the end tag of an element whose content is no markup; the end of the page if it has none."""
    end = _RAW_END[tag].search(page, at)
    close = page.find(">", end.end()) if end else -1
    return close + 1 if close >= 0 else len(page)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (a parent before its children), and text blocks as (node, text)."""
    nodes = [Node("#root", -1, ())]
    stack = _Stack()
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    at, size, headed = 0, len(page), False

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                here = stack.blocks[-1]
                blocks.append((here, text))
                nodes[here].stop |= text[-1] in ".!?…" or ". " in text

    def words(raw: str) -> None:
        if raw and not stack.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            node, solid = nodes[stack.blocks[-1]], len(text) if not text.isspace() else 0
            node.chars += solid
            if stack.links:
                node.linked += solid
            run.append(text)

    def close(depth: int) -> None:
        if any(stack.tags[d] in BLOCK for d in range(len(stack.tags) - 1, depth - 1, -1)):
            flush()
        stack.close(depth)

    while at < size:
        start = _OPEN.search(page, at)
        if start is None:
            words(page[at:])
            break
        words(page[at : start.start()])
        at = start.start()
        if page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 2)
            at = end.end() if end else size
            continue
        m = _TAG.match(page, at) or _PLAIN.match(page, at)
        if m is None:
            end = page.find(">", at)  # a comment of another kind, or a tag that the page breaks off in
            at = end + 1 if end >= 0 else size
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            depth = stack.last((tag,))
            if depth and (tag in BLOCK or depth > stack.last(("td", "th", "table"))):
                close(depth)
            continue
        if tag == "head":
            if not headed:  # its end tag may be missing
                headed = True
                end, body = _RAW_END["head"].search(page, at), _BODY.search(page, at)
                if end or body:
                    at = min(x.start() for x in (end, body) if x)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                at = _skip_raw(page, tag, at)
            continue
        if tag == "br":
            if not stack.hidden:
                run.append(" ")
            continue
        if tag in BLOCK:
            depth = stack.last(("p",))  # a block ends an open paragraph
            if depth > stack.last(P_SCOPE):
                close(depth)
            ends = HIDDEN - {"template"} if tag in ("article", "main") else ENDED
            if stack.hidden and (depth := stack.outermost_above(ends, stack.last(("template",)))):
                close(depth)
            if tag in CLOSES:
                shut, stop = CLOSES[tag]
                if depth := stack.outermost_above(shut, stack.last(stop)):
                    close(depth)
            flush()
            if tag not in VOID:
                nodes.append(Node(tag, stack.blocks[-1], _kind(tag, m[3])))
                stack.push(tag, len(nodes) - 1)
        elif tag not in VOID:
            if tag == "button" and (depth := stack.last(("button",))):
                close(depth)
            if not (tag in HIDDEN and m[3].rstrip().endswith("/")):
                stack.push(tag, stack.blocks[-1])
    close(1)
    flush()
    for n in nodes[1:]:
        if n.chars:
            nodes[n.parent].company += 1
    _free(nodes)
    return nodes, blocks


def _free(nodes: list[Node]) -> None:
    """Names tell nothing of elements that hold the page: its one article, what is around it, or without one most of the text."""
    held = [n.chars for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] += held[i]
    articles = [i for i, n in enumerate(nodes) if n.tag in GOOD_TAGS]
    if len(articles) == 1:
        free, at = [], articles[0]
        while at > 0:
            free.append(at)
            at = nodes[at].parent
    else:
        free = [i for i in range(1, len(nodes)) if 2 * held[i] > held[0] and nodes[i].tag not in BAD_TAGS] if not articles else []
    for i in free:
        if _AT["bad_name"] in nodes[i].kind:
            nodes[i].kind = tuple(f for f in nodes[i].kind if f != _AT["bad_name"])


_BAD, _GOOD = {_AT["bad_tag"], _AT["bad_name"]}, {_AT["good_tag"], _AT["good_name"]}


def observed(node: Node) -> bool:
    """Whether the node's markup says that it is not content."""
    return not _BAD.isdisjoint(node.kind)


def features(node: Node, parent: Node | None = None) -> tuple:
    if not node.chars or node.tag in ("#root", "html", "body"):
        return node.kind
    part, holder = node.linked / node.chars, KINDS.get(node.tag, "is_other")
    # Items and cells always come in numbers, in menus as in texts.
    company = (_AT["in_company" if parent.company > 2 else "alone"],) if parent and holder not in ("is_item", "is_cell") else ()
    return (
        *node.kind,
        _AT["links_none" if part == 0 else "links_some" if part < 0.6 else "links_most"],
        _AT["short" if node.chars < 25 else "middle" if node.chars < 100 else "long"],
        _AT["stop" if node.stop else "no_stop"],
        *((_AT[holder],) if holder not in ("is_item", "is_cell") else ()),
        *company,
    )


def labels(nodes: list[Node]) -> list[bool] | None:
    """Labels of a page whose markup names its one article; None for another page."""
    if sum(n.tag in GOOD_TAGS for n in nodes) != 1:
        return None
    out: list[bool] = []
    for n in nodes:
        inside = n.tag in GOOD_TAGS or n.parent >= 0 and out[n.parent]
        out.append(inside and not observed(n))
    return out


class Model:
    """Log odds of content: one for each feature, and for a child given its parent's label and its own markup."""

    def __init__(self, weights: list[float], up: list[float]):
        #: up[2 * good + y]: log odds that a child is content if its parent's label is y; good: its markup says article.
        self.weights, self.up, self.known = weights, up, {}
        self.edges = []
        for good in (0, 1):
            (a, b), (c, d) = [(1 / (1 + math.exp(o)), 1 / (1 + math.exp(-o))) for o in up[2 * good : 2 * good + 2]]
            self.edges.append((a, b, c, d))  # P(0|0), P(1|0), P(0|1), P(1|1)

    def potential(self, found: tuple) -> float:
        if found not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[found] = sum(self.weights[f] for f in found)
        return self.known[found]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Log odds of every node's marginal, by messages up the tree and down."""
        belief, edge, out = [], [], []
        for n in nodes:
            out.append(observed(n) or n.parent >= 0 and out[n.parent])  # with all that is in it
            if out[-1]:
                belief.append(-500.0)
                edge.append(None)  # an observed node says nothing about its parent
            else:
                belief.append(self.potential(features(n, nodes[n.parent] if n.parent >= 0 else None)))
                edge.append(self.edges[not _GOOD.isdisjoint(n.kind)])
        sent = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            if edge[i]:
                a, b, c, d = edge[i]
                odds = math.exp(max(-500.0, min(500.0, belief[i])))
                sent[i] = math.log((c + d * odds) / (a + b * odds))
                belief[nodes[i].parent] += sent[i]
        for i in range(1, len(nodes)):
            if edge[i]:
                a, b, c, d = edge[i]
                odds = math.exp(max(-500.0, min(500.0, belief[nodes[i].parent] - sent[i])))
                belief[i] += math.log((b + d * odds) / (a + c * odds))
        return belief

    def text(self, page: str) -> str:
        nodes, blocks = parse(page)
        odds = self.marginals(nodes)
        return "\n".join(t for n, t in blocks if odds[n] >= 0)


def fit(counts: dict[tuple[str, int, int], int]) -> Model:
    """Potentials from counts (what, which, label): "node", "feature", and "edge" (2 * good + parent's label, child's)."""
    total = [counts.get(("node", 0, y), 0) + 2.0 for y in (0, 1)]
    weights = []
    for i, name in enumerate(FEATURES):
        strong = name[:4] in ("good", "bad_", "form")
        prior = {"good": (1, 40), "bad_": (40, 1), "form": (20, 1)}.get(name[:4], (1, 1))
        no, yes = (counts.get(("feature", i, y), 0) + prior[y] for y in (0, 1))
        ratio = math.log(yes / (total[1] + sum(prior))) - math.log(no / (total[0] + sum(prior)))
        most = STRONG if strong else MIDDLE if name.startswith("is_") else WEAK
        weights.append(max(-most, min(most, ratio)))
    up, most = [], math.log(STAY / (1 - STAY))
    for k, (no_prior, yes_prior) in enumerate(((200, 1), (1, 200), (2, 2), (1, 20))):
        no, yes = counts.get(("edge", k, 0), 0) + no_prior, counts.get(("edge", k, 1), 0) + yes_prior
        up.append(max(-most, min(most, math.log(yes / no))))
    return Model(weights, up)


def count_labelled(pages: Iterator[str]) -> Counter:
    counts: Counter = Counter()
    for page in pages:
        nodes, _ = parse(page)
        found = labels(nodes)
        if found is None:
            continue
        for n, y in zip(nodes[1:], found[1:], strict=True):
            counts["node", 0, int(y)] += 1
            for f in features(n, nodes[n.parent]):
                counts["feature", f, int(y)] += 1
            if not observed(n):
                counts["edge", 2 * (not _GOOD.isdisjoint(n.kind)) + found[n.parent], int(y)] += 1
    return counts


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = 2000) -> Model:
    """Fit the potentials on labelled pages, at most ``sample_pages`` of them; without any, on priors."""
    ship_package(pages.sparkSession)
    page = text_of(html_col)
    labelled = pages.select(page.alias("html")).filter(page.rlike("(?i)<(?:article|main)[\\s>]")).withColumn("draw", F.xxhash64("html"))
    limit = labelled.select("draw").distinct().orderBy("draw").limit(sample_pages).agg(F.max("draw")).first()[0]
    if limit is None:
        return fit({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total += count_labelled(h.as_py() for h in b.column(0))
        rows = [(*k, n) for k, n in total.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["what", "which", "label", "n"]
        )

    # Counted where the pages lie: copies of one page count once for each, and no page moves.
    counted = labelled.filter(F.col("draw") <= limit).select("html").mapInArrow(count, "what string, which int, label int, n bigint")
    rows = counted.groupBy("what", "which", "label").agg(F.sum("n").alias("n")).collect()
    return fit({(r["what"], r["which"], r["label"]): r["n"] for r in rows})


def extract_text(pages: DataFrame, carry: Sequence[Column | str] = ("*",), html_col: str = "html", model: Model | None = None) -> DataFrame:
    """The main text of every page.

    Returns one row per input row: ``row`` (a struct of the ``carry`` columns) and ``text``: the blocks of
    the main content in page order, joined by line feeds, with character references decoded and white
    space inside a block turned into one space; empty if there is none.

    A null page counts as empty; repeated rows are treated alike; broken markup is read as HTML's rules
    for open paragraphs, lists and tables say, and a tag that the page breaks off in is dropped; an empty
    table gives an empty result. Other columns ride along inside ``row``, whatever their names.
    """
    ship_package(pages.sparkSession)
    model = model or train(pages, html_col)
    weights, up = model.weights, model.up
    source = pages.select(F.struct(*carry).alias("row"), text_of(html_col).alias("html"))
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, up)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.text(h.as_py()) for h in b.column(1)], pa.string())], ["row", "text"])

    return source.mapInArrow(apply, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of the whole of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, carry=["page_id", "url"]).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
