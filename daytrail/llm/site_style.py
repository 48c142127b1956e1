"""Main text of web pages with site style trees.

Pages of a host are merged into one tree, each distinct page once: a node is a path of tags and
classes below the root that holds text of its own. Of each node is known on how many pages it
stands, in how many presentations (the tags of its children) and with how many contents (its text).
Both give an entropy, scaled to 0..1 by the number of pages. A node's importance is its content
entropy, and what is missing to 1 is made up by its presentations, the less so the fewer there are.
What is the same on every page (menus, notices) has an importance near 0, what differs (articles)
near 1. On nodes below ``LEAST`` a text is cut if it stands there on a hundredth of the pages, and
on two at least.

The tree judges every block of hosts with ``FEWEST`` distinct pages or more, inside ``article`` and
``main`` as outside. Names are a check after it: nav, header, footer, aside, form and the like, and
classes that name menus, adverts, notices, sidebars or comments, are noise, but not ``html`` and
``body``, nor branches around an article, nor, on pages without one, branches that hold most of the
text by a class, id or role, or as a form. On hosts with fewer pages names alone decide: a page that
has an ``article`` or ``main`` is read inside it only.

Each page is parsed once, in Arrow batches. A host's pages never meet in a task: node statistics
are counted with map-side combining.

Defined cases: null or empty html gives an empty text; broken, unclosed or cut off markup is read
to its end; a page without a readable host has a host of its own kind (null) and keeps its neutral
branches; rows with equal ids are pages of their own; very deep nesting is cut into at most
``DEEPEST`` levels of path; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrail.session import cut_lineage

LEAST, FEWEST, DECAY, DEEPEST = 0.5, 4, 0.9, 64
#: Texts that stand on fewer of a node's pages, in percent, are not cut: at most so many a node are.
TEMPLATE = 1

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CONTENT = frozenset("article main".split())
NOISE = frozenset(
    "nav header footer aside script style noscript template head button select option textarea "
    "iframe object svg canvas dialog menu title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
# Start tags that end an open element of the second kind, when nothing of the third is between.
LISTS, TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
ENDS = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), TABLE),
    "td": (frozenset(("td", "th")), TABLE | {"tr"}),
    "th": (frozenset(("td", "th")), TABLE | {"tr"}),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo "
    "related reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog navigation search".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "path", "noise", "named", "holds_content", "children", "text", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.noise, self.named, name = tag in NOISE, tag == "form", tag
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                words = frozenset(re.split(r"[\s_-]+", "".join(values).lower()))
                if key.lower() == "role":
                    self.named |= bool(words & NOISE_ROLES)
                    continue
                self.named |= bool(words & NOISE_WORDS)
                if key.lower() == "class":
                    name = f"{tag}.{'.'.join(sorted(words - {''}))}"
        if tag in ("html", "body"):
            self.named = False
        if parent is None:
            self.path = ""
        else:
            self.path = f"{parent.path}/{name}" if parent.path.count("/") < DEEPEST else parent.path
        self.holds_content, self.children, self.text = False, [], []


class Page:
    """A page's tree and its blocks (node, text), in page order."""

    def __init__(self, source: str):
        self.root = self.here = Node("", "", None)
        self.nodes, self.blocks, self.pending = [], [], []
        self.owner = self.root
        self.depth = 0
        at, n = 0, len(source)
        while at < n:
            found = _MARKUP.search(source, at)
            if not found:
                self.words(source[at:])
                break
            if found.start() > at:
                self.words(source[at : found.start()])
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self.end(tag)
                    continue
                self.start(tag, found[3])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    if tag == "textarea" or tag == "title":
                        self.words(source[at : close.start() if close else n])
                    self.end(tag)
                    at = close.end() if close else n
        self.flush()

    def words(self, text: str) -> None:
        if not self.pending:
            self.owner = self.block()
        self.pending.append(text)
        self.here.text.append(text)

    def block(self) -> Node:
        node = self.here
        while node.tag in INLINE and node.parent is not None:
            node = node.parent
        return node

    def flush(self) -> None:
        if self.pending:
            # Joined before decoding: markup inside a word does not split it.
            text = " ".join(html.unescape("".join(self.pending)).split())
            if text:
                self.blocks.append((self.owner, text))
            self.pending = []

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.pending.append("\n")
            if tag in VOID:
                return
        else:
            self.flush()
            if tag in ENDS:
                self.close(*ENDS[tag])
            else:
                self.close(frozenset(("p",)), frozenset(("button", "table", "td", "th", "caption", "object")))
        node = Node(tag, attributes, self.here)
        self.here.children.append(tag)
        self.nodes.append(node)
        if tag in CONTENT:
            up = self.here
            while up is not None and not up.holds_content:
                up.holds_content = True
                up = up.parent
        if tag not in VOID:
            self.here = node

    def close(self, kinds: frozenset[str], fence: frozenset[str]) -> None:
        node = self.here
        while node.parent is not None and node.tag not in fence:
            if node.tag in kinds:
                self.here = node.parent
                # A row ends its open cell too.
                if "tr" not in kinds:
                    return
            node = node.parent

    def end(self, tag: str) -> None:
        node = self.here
        while node.parent is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return  # a stray end of a formatting element
            node = node.parent
        if node.parent is None:
            if tag == "p":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
        self.here = node.parent


def verdicts(page: Page) -> list[tuple[str, str, bool]]:
    """(path, text, sure) of the blocks that are not noise by their names; sure: so far as names
    tell, they are the page's content."""
    marked = page.root.holds_content
    below: dict[int, int] = {}  # length of the text below each node, but for what tags call noise
    seen = []
    for node, text in page.blocks:
        inside, line = False, []
        while node is not None:
            inside |= node.tag in CONTENT
            line.append(node)
            node = node.parent
        # A branch around the article is no noise whatever its name.
        if not any(up.noise and not up.holds_content for up in line):
            seen.append((line, text, inside))
            for up in line:
                below[id(up)] = below.get(id(up), 0) + len(text)
    most = below.get(id(page.root), 0) / 2
    return [
        (line[0].path, text, inside or not marked)
        for line, text, inside in seen
        if not any(up.named and not up.holds_content and (marked or below[id(up)] <= most) for up in line)
    ]


def node_rows(page: Page, blocks: list[tuple[str, str, bool]]) -> list[tuple[str, str, str]]:
    """(path, presentation, content) of each path with blocks, over all its nodes on the page."""
    seen: dict[str, tuple[list[str], list[str]]] = {path: ([], []) for path, _, _ in blocks}
    for node in page.nodes:
        if node.path in seen:
            seen[node.path][0].append(",".join(node.children))
    for path, text, _ in blocks:
        seen[path][1].append(text)
    return [(path, "|".join(style), "\n".join(text)) for path, (style, text) in seen.items()]


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks, nodes); nodes carry hashes of presentation and content."""
    kind = pages.schema["page_id"].dataType.simpleString()
    block = pa.struct([("path", pa.string()), ("text", pa.string()), ("sure", pa.bool_())])
    node = pa.struct([("path", pa.string()), ("style", pa.string()), ("content", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, nodes = [], []
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                found = verdicts(page)
                blocks.append([dict(zip(("path", "text", "sure"), b, strict=True)) for b in found])
                nodes.append([dict(zip(("path", "style", "content"), x, strict=True)) for x in node_rows(page, found)])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "url", "host")),
                    pa.array(blocks, pa.list_(block)),
                    pa.array(nodes, pa.list_(node)),
                ],
                ["page_id", "url", "host", "blocks", "nodes"],
            )

    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    parsed = pages.select("page_id", F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string")).mapInArrow(
        scan,
        f"page_id {kind}, url string, host string, blocks array<struct<path: string, text: string, sure: boolean>>, "
        "nodes array<struct<path: string, style: string, content: string>>",
    )
    return parsed.withColumn(
        "nodes",
        F.transform(
            "nodes",
            lambda n: F.struct(n["path"].alias("path"), F.xxhash64(n["style"]).alias("style"), F.xxhash64(n["content"]).alias("content")),
        ),
    )


def distinct_pages(parsed: DataFrame) -> DataFrame:
    """(host, nodes) of each distinct page of a host; pages whose blocks are the same are one."""
    whole = parsed.where("host IS NOT NULL").select("host", F.xxhash64("blocks").alias("page"), "nodes")
    return whole.dropDuplicates(["host", "page"]).select("host", "nodes")


def _entropy(nodes: DataFrame, what: str) -> DataFrame:
    each = nodes.groupBy("host", "path", what).agg(F.count(F.lit(1)).alias("c"))
    spread = F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")
    return each.groupBy("host", "path").agg(
        F.sum("c").alias("pages"),
        F.count(F.lit(1)).alias("variants"),
        F.when(F.sum("c") > 1, spread / F.log(F.sum("c"))).otherwise(1.0).alias("h"),
    )


def _tree(nodes: DataFrame) -> DataFrame:
    styles = _entropy(nodes, "style").select("host", "path", "pages", F.col("variants").alias("styles"), F.col("h").alias("style_h"))
    contents = _entropy(nodes, "content").select("host", "path", F.col("h").alias("content_h"))
    weight = F.pow(F.lit(DECAY), F.col("styles") - 1)
    return styles.join(contents, ["host", "path"]).select(
        "host", "path", "pages", "styles",
        # Many presentations add importance; they never take from that of the contents.
        F.greatest("content_h", (1 - weight) * F.col("style_h") + weight * F.col("content_h")).alias("importance"),
    )


def _opened(pages: DataFrame) -> DataFrame:
    return pages.select("host", F.explode("nodes").alias("n")).select("host", "n.*")


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, path, pages, styles, importance) of each node of each host's tree."""
    return _tree(_opened(distinct_pages(parsed)))


def judgements(parsed: DataFrame) -> DataFrame:
    """(host, cut) of the hosts with ``FEWEST`` distinct pages; cut: (path, content) that go, or null."""
    pages = cut_lineage(distinct_pages(parsed))
    nodes = _opened(pages)
    low = _tree(nodes).where((F.col("pages") >= FEWEST) & (F.col("importance") < LEAST)).select("host", "path", "pages")
    cut = (
        nodes.groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("c"))
        .join(low, ["host", "path"])
        .where((F.col("c") >= 2) & (100 * F.col("c") >= TEMPLATE * F.col("pages")))
        .groupBy("host").agg(F.collect_set(F.struct("path", "content")).alias("cut"))  # of one site's templates
    )
    known = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEWEST).select("host")
    return known.join(cut, "host", "left").withColumn("judged", F.lit(True))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""
    parsed = cut_lineage(parse(pages))
    met = parsed.join(cut_lineage(judgements(parsed)), "host", "left")
    gone = F.transform(
        F.filter("nodes", lambda n: F.coalesce(F.array_contains("cut", F.struct(n["path"].alias("path"), n["content"].alias("content"))), F.lit(False))),
        lambda n: n["path"],
    )
    kept = met.withColumn("gone", gone).select(
        "page_id", "url",
        F.filter(
            "blocks", lambda b: F.when(F.col("judged"), ~F.array_contains("gone", b["path"])).otherwise(b["sure"])
        ).alias("blocks"),
    )
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return kept.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
