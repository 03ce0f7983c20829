"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path: an element is the same style node on every page where
its tag and class, and those of all elements above it, are the same. A style node is the more
important the more its presentation (the sequence of its children) and its contents (texts, links)
differ between pages, by their entropies; what looks and reads the same everywhere is a site's
furniture. Branches of low importance are cut from each page, together with those that their tags,
roles and class names declare to be furniture: a menu, an advert or a footer that differs from page
to page is as important to the tree as the article is. What is left of the article is its main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import cut, parts

#: Branches with less importance are cut, if so many different pages of the host have them.
LOW, MIN_PAGES = 0.2, 8
#: Weight that a child's importance keeps in its parent's, by number of children.
DECAY = 0.9
#: Cut branches up to which their table is sent to all executors (some MB); beyond, pages and branches are shuffled by host,
#: each host dealt to SALTS groups of pages.
SMALL, SALTS = 200_000, 64
#: Characters of pages that are parsed together.
CHUNK = 1 << 22

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
#: An element that a new one of the kind ends, and the elements that it is looked for inside of.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NO_PARAGRAPH = frozenset("td th caption button object template table html body".split())

NO_TEXT = frozenset("script style noscript template svg math canvas iframe object audio video head title noembed noframes xmp".split())
FURNITURE = frozenset("nav aside footer form menu dialog button select textarea input label fieldset datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|billboard|cookies?|consent|gdpr|notices?|alerts?|popup|modal"
    r"|overlay|sidebar\w*|widgets?|menus?|nav\w*|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|repl(?:y|ies)|respond"
    r"|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|pagination|pager|skip-link|site-header|page-header"
    r"|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: What an article is made of; kept inside it, however often a site repeats it.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())


class Node:
    __slots__ = ("attributes", "children", "key", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        look = re.sub(r"\d{3,}", "0", " ".join(sorted(attributes.get("class", "").lower().split())))
        self.key = xxhash.xxh64_intdigest(f"{parent.key if parent else 0} {tag} {look}") >> 1


def parse(text: str) -> Node:
    """The elements and texts of a page; ends that are left out are put in as browsers do, ends without a beginning are ignored."""
    root = now = Node("#page", None, {})
    at = 0

    def add(data: str) -> None:
        if data:
            now.children.append(html.unescape(data) if "&" in data else data)

    while match := TAG.search(text, at):
        add(text[at : match.start()])
        at = match.end()
        end, name, rest = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not name:
            if text.startswith("<![CDATA[", match.start()):
                now.children.append(match.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if end:
            node = now
            while node.parent and node.tag != name:
                if name not in BLOCK and node.tag in BLOCK:  # an inline end doesn't end a block
                    node = root
                    break
                node = node.parent
            if node.parent:
                now = node.parent
            continue
        if name in BLOCK:
            node = now
            while node.parent and node.tag != "p" and node.tag not in NO_PARAGRAPH:
                node = node.parent
            if node.tag == "p":
                now = node.parent
        if name in ENDED:
            ends, inside = ENDED[name]
            node = now
            while node.parent and node.tag not in ends and node.tag not in inside:
                node = node.parent
            if node.tag in ends:
                now = node.parent
        attributes = {}
        if rest.strip(" /"):
            for key, *values in ATTRIBUTE.findall(rest):
                attributes.setdefault(key.lower(), html.unescape("".join(values)))
        node = Node(name, now, attributes)
        now.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(text, at)
            stop = close.start() if close else len(text)
            node.children.append(text[at:stop] if name not in ("title", "textarea") else html.unescape(text[at:stop]))
            at = text.find(">", stop) + 1 if close else len(text)
            at = at or len(text)
        elif name not in VOID and not (rest.rstrip().endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "em", "span")):
            now = node
    add(text[at:])
    return root


def nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def declared_furniture(node: Node, in_article: bool) -> bool:
    """Whether tag, role or class name say that the element is no part of the main text."""
    a = node.attributes
    if node.tag in NO_TEXT or node.tag in FURNITURE or (node.tag == "header" and not in_article):
        return True
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("article", "main", "body", "html"):
        return node.tag == "article" and bool(re.search(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|teaser|related|promo\w*)(?:$|[\s_-])", a.get("class", ""), re.I))
    return bool(NAMES.search(f"{a.get('class', '')} ") or NAMES.search(a.get("id", "")))


def blocks(root: Node, low: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks of the main text, in their order, without the branches of the style nodes ``low``.

    The main text is that of the article; of the main element or the whole page where there is none.
    """

    def usable(node: Node) -> bool:
        while node.parent:
            if declared_furniture(node, False):
                return False
            node = node.parent
        return True

    inside = [n for n in nodes(root) if n.tag == "article" and usable(n)]
    if not inside:
        inside = [n for n in nodes(root) if (n.tag == "main" or n.attributes.get("role", "").lower() == "main") and usable(n)]
    semantic = bool(inside)
    tops = {id(n) for n in inside}
    starts = [n for n in inside if not any(id(p) in tops for p in _above(n))] or [root]
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    for start in starts:
        stack: list[Node | str | None] = [start]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                now.append(node)
            elif node is not start and declared_furniture(node, semantic):
                now.append(" ")
                if node.tag in BLOCK:
                    flush()
            elif node.key in low and node is not start and not (semantic and node.tag in PROSE):
                flush()
            elif node.tag == "br":
                now.append(" ")
            else:
                if block := node.tag in BLOCK or node is start:
                    flush()
                    stack.append(None)
                stack.extend(reversed(node.children))
        flush()
    return out


def _above(node: Node) -> Iterator[Node]:
    while node := node.parent:
        yield node


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?|[:/?#].*$", "", (url or "").strip().lower(), flags=re.S)


ROWS = "host string, node long, parent long, kind int, value long, page long"


def _style_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each element of each page: its presentation (kind 0) and its contents (kind 1), once for each page."""
    for batch in batches:
        for rows, texts in parts(batch, 1, CHUNK):
            columns: list[list] = [[] for _ in range(6)]
            for url, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                page, host = xxhash.xxh64_intdigest(text) >> 1, host_of(url)
                seen = set()
                for node in nodes(parse(text)):
                    if node.parent is None or node.tag in NO_TEXT:
                        continue
                    kinds = [c.key if isinstance(c, Node) else 0 for c in node.children if isinstance(c, Node) or c.strip()]
                    look = tuple(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])
                    parent = node.parent.key if node.parent.parent else -1
                    seen.add((node.key, parent, 0, xxhash.xxh64_intdigest(repr(look)) >> 1))
                    contents = [" ".join(c.split()) for c in node.children if isinstance(c, str)]
                    contents += [node.attributes[k] for k in ("href", "src") if k in node.attributes]
                    seen.update((node.key, parent, 1, xxhash.xxh64_intdigest(c) >> 1) for c in contents if c)
                for key, parent, kind, value in seen:
                    for c, v in zip(columns, (host, key, parent, kind, value, page), strict=True):
                        c.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, parent, pages, presentation, contents, kinds, texts) of every style node of every host.

    ``presentation`` is the entropy of its presentations over the logarithm of its pages, ``contents``
    one less the mean entropy of its contents over the same; both are 1 where there is one page.
    Pages that are equal count once.
    """
    counts = (
        pages.select("url", "html")
        .mapInArrow(_style_batches, ROWS)
        .distinct()
        .groupBy("host", "node", "parent", "kind", "value")
        .agg(F.count("*").alias("k"))
    )
    k = F.col("k").cast("double")
    look, content = F.col("kind") == 0, F.col("kind") == 1
    summed = counts.groupBy("host", "node", "parent").agg(
        F.sum(F.when(look, F.col("k"))).alias("pages"),
        F.sum(F.when(look, k * F.log(k))).alias("klogk"),
        F.count(F.when(look, 1)).alias("kinds"),
        F.count(F.when(content, 1)).alias("texts"),
        F.avg(F.when(content, F.log(k))).alias("logk"),
    )
    many, log = F.col("pages") > 1, F.log(F.col("pages").cast("double"))
    return summed.select(
        "host", "node", "parent", "pages",
        F.when(many, (log - F.col("klogk") / F.col("pages")) / log).otherwise(1.0).alias("presentation"),
        F.when(many, F.greatest(F.lit(0.0), 1 - F.col("logk") / log)).otherwise(1.0).alias("contents"), "kinds", "texts",
    )


def importances(nodes_of_hosts: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, node, pages, importance) of the style nodes that ``min_pages`` pages have: presentation and contents of a node and of all below it.

    A child that fewer pages have says nothing of the site and counts as important. So the group of a host
    has the elements of its templates, and not those that single pages make up.
    """
    often = F.col("pages") >= min_pages
    rare = nodes_of_hosts.where(~often).groupBy("host", "parent").agg(F.count("*").alias("rare"))
    kept = nodes_of_hosts.where(often).join(rare.withColumnRenamed("parent", "node"), ["host", "node"], "left")

    def merged(pdf):
        pdf["rare"] = pdf["rare"].fillna(0).astype(int)
        rows = {r.node: r for r in pdf.itertuples()}
        below: dict[int, list[int]] = {}
        for r in rows.values():
            below.setdefault(r.parent, []).append(r.node)
        order, stack = [], [n for n, r in rows.items() if r.parent not in rows]
        while stack:
            order.append(node := stack.pop())
            stack.extend(below.get(node, ()))
        value: dict[int, float] = {}
        for node in reversed(order):
            r = rows[node]
            own = [value[c] for c in below.get(node, ())] + [float(r.contents)] * bool(r.texts)
            count, children = len(own) + r.rare, len(below.get(node, ())) + r.rare
            inner = (sum(own) + r.rare) / count if count else float(r.presentation)
            keep = DECAY**children if children else 1.0
            value[node] = (1 - keep) * float(r.presentation) + keep * inner
        pdf = pdf[["host", "node", "pages"]].copy()
        pdf["importance"] = [value.get(n, 1.0) for n in pdf["node"]]
        return pdf

    return kept.groupBy("host").applyInPandas(merged, "host string, node long, pages long, importance double")


TEXT = "page_id long, url string, text string, n_chars long"


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in TEXT.split(", ")]
    for batch in batches:
        for rows, pages in parts(batch, 2, CHUNK):
            cuts = (frozenset(low.as_py() or ()) for low in rows.column(3))
            texts = ["\n".join(blocks(parse(page), low)) for page, low in zip(pages, cuts, strict=True)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), lengths], names)


def main_texts(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, any others).

    Blocks are joined by line ends, white space inside them is one space. A null or empty page has an
    empty text, as has one that is all furniture. Pages without a url are one host. Repeated rows give
    repeated rows. No rows give no rows.
    """
    found = importances(cut(style_nodes(pages)), min_pages).where(F.col("importance") < low)
    branches = cut(found.groupBy("host").agg(F.collect_list("node").alias("low"), F.count("*").alias("n")))
    size = branches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    branches = branches.select(F.col("host").alias("branch_host"), "low")
    host = F.regexp_replace(
        F.lower(F.trim(F.coalesce("url", F.lit("")))), r"(?s)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?|[:/?#].*$", ""
    )
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    if size <= SMALL:
        joined = rows.join(F.broadcast(branches), F.col("host") == F.col("branch_host"), "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        branches = branches.withColumn("branch_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(branches, (F.col("host") == F.col("branch_host")) & (F.col("salt") == F.col("branch_salt")), "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extract_batches, TEXT)
