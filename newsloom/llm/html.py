"""HTML extraction by site template removal.

Every element's subtree (tags and text) is hashed; Spark counts on how many pages of a host each hash
occurs; subtrees that recur on many pages of their host are deleted, the outermost first. What is left
is the page's content, without elements whose name, role or class says that they are no part of an
article (scripts, forms, menus, adverts, comments and the like), which serves hosts of few pages. Classes are
matched whole, and neither a class nor ``form`` drops an element with over half of the page's text (but reader
comments); a page's only articles or main parts are kept wherever they are.

A page's article is its outermost ``article`` elements, else ``main`` (or role main), else the body. Inside
an ``article`` or ``main`` recurring containers (divisions, sections, whole lists and tables: share bars, related boxes,
notices) are deleted too. Paragraphs, headings, quotations, list items, cells and inline elements stay there: a licence
line is the author's text, however many pages repeat it. So does a container with over half of the part's text, as the
body of a copied article has; containers inside it are judged on their own.

A null or empty page, and one whose every block is deleted, has the text ''. Malformed markup never
fails: an end tag without a start is skipped, open elements end with their parent, and elements may nest without limit. Rows that repeat
page_id and html are one page for the counts, and each has its text; a null page_id or url is a value like others (pages without a url
share the host ''); an empty table gives an empty one; pages are read whole, however long.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A subtree is template if so many pages of its host have it, and at least this share of them.
LEAST_PAGES = 4
LEAST_SHARE = 0.02

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|noscript|template|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Never part of an article.
DROPPED = frozenset("head nav aside form button select dialog footer menu object video audio canvas".split())
#: The element that a start tag of these closes, if it is open inside its container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article main body td th blockquote".split())
_NOISY = r"(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed)?|banner|promo|comments?|respond|cookies?|consent|gdpr|notice|sidebar|side-bar|breadcrumbs?|menu|navbar|nav|pagination|pager|related|recommend(?:ed|ations?)?|share|social|newsletter|subscribe|subscription|signup|login|popup|modal|footer|masthead|skip-link|widget)"
_NEUTRAL = r"(?:area|bar|block|box|button|buttons|container|content|form|group|inner|items?|left|link|links|list|outer|panel|post|posts|right|section|site|slot|top|bottom|unit|wrap|wrapper|\d+)"
#: A whole class or id of noise words, perhaps with words that say only what kind of box it is: "ad-slot", "related-posts", but
#: not "has-sidebar" or "pull-share". A box word leads only where it says nothing of the content ("site-footer").
NOISE = re.compile(rf"(?:(?:site|top|bottom|left|right)[-_]+)?{_NOISY}(?:[-_]+(?:{_NOISY}|{_NEUTRAL}))*", re.I)
#: Of these, what makes a paragraph or figure inside an article no part of it.
ADVERT = re.compile(rf"(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed)?)(?:[-_]+{_NEUTRAL})*", re.I)
#: Reader comments are dropped however long they are.
READERS = re.compile(rf"(?:comments?|respond)(?:[-_]+(?:{_NOISY}|{_NEUTRAL}))*", re.I)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dt dd tr td th em strong b i span a code q cite mark small sub sup".split())
#: What may be deleted for recurring inside an article or main part, as may elements with a hyphen in the name.
CONTAINER_PARTS = frozenset("address center details div dl fieldset figure footer header ol section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "children", "noise", "soft", "kept", "inside", "protects", "hash", "size")

    def __init__(self, name: str, noise: bool = False, soft: bool = False, inside: bool = False):
        self.name, self.noise, self.soft = name, noise, soft
        self.children: list = []
        self.kept = False  # an article or main part
        self.inside = inside  # below one
        self.protects = False  # above one
        self.hash = 0
        self.size = 0  # characters other than white space, less those of elements that are dropped whatever their size


class Root(Node):
    """A page; nodes: it and all its elements in the order of their start tags, so parents come before children."""

    __slots__ = ("nodes",)

    def __init__(self):
        super().__init__("#root")
        self.nodes: list[Node] = [self]


def _noisy(name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is dropped; whether only if it has at most half of the page's text; whether it is a main part by its role."""
    if name in DROPPED or (name == "header" and not inside):
        return True, name == "form", False
    if not attrs or attrs == "/":
        return False, False, False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    role = values.get("role", "").lower()
    if name in {"article", "main", "body", "html"}:
        return False, False, role == "main"
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I)
    if hidden or role in ROLES:
        return True, role == "form" and not hidden, role == "main"
    tokens = f"{values.get('class', '')} {values.get('id', '')}".split()
    noise = ADVERT if inside and name in PROSE else NOISE
    return any(map(noise.fullmatch, tokens)), not any(map(READERS.fullmatch, tokens)), role == "main"


def parse(page: str | None) -> Root:
    """The page's elements, however deep; open elements are counted by name, so that a stray end tag searches nothing."""
    root = Root()
    stack: list[Node] = [root]
    open_: dict[str, int] = {}
    at, inside = 0, 0
    page = page or ""

    def close(i: int) -> None:
        nonlocal inside
        for n in stack[i:]:
            open_[n.name] -= 1
            inside -= n.kept
        del stack[i:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if open_.get(name):
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                close(i)
            continue
        ends = CLOSES.get(name)
        if ends is not None and any(open_.get(x) for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    close(i)
                    break
                if stack[i].name in CONTAINERS:
                    break
        noise, soft, main = _noisy(name, m["attrs"], inside > 0)
        node = Node(name, noise, soft, inside > 0)
        stack[-1].children.append(node)
        root.nodes.append(node)
        if name not in VOID and not m["attrs"].endswith("/"):
            node.kept = name in {"article", "main"} or main
            inside += node.kept
            open_[name] = open_.get(name, 0) + 1
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(entities.unescape(page[at:]))
    measure(root)
    return root


def measure(root: Root) -> None:
    """Set sizes, and which elements have an article or main part below. No noise any more: an element that its class alone would
    drop, but that has over half of the page's text."""
    for node in reversed(root.nodes):
        for c in node.children:
            if isinstance(c, str):
                node.size += sum(map(len, c.split()))
            else:
                node.size += c.size
                node.protects |= c.kept or c.protects
        if node.noise and not node.soft:
            node.size = 0
    for node in root.nodes:
        if node.noise and node.soft and 2 * node.size > root.size:
            node.noise = False


def separable(node: Node) -> bool:
    """Whether an element inside an article or main part may be template."""
    return not node.kept and (node.name in CONTAINER_PARTS or "-" in node.name)


def hashes(root: Root) -> None:
    """Set the hash of every element's subtree."""
    for node in reversed(root.nodes):
        parts = [node.name]
        for c in node.children:
            if isinstance(c, str):
                if text := SPACE.sub(" ", c).strip():
                    parts.append(f"t{text}")
            else:
                parts.append(str(c.hash))
        node.hash = xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def open_subtrees(root: Root) -> list[int]:
    """Hashes of the subtrees with text that may be template: any outside of articles and main parts, containers inside."""
    out: dict[int, None] = {}
    filled: set[int] = set()
    for node in reversed(root.nodes):
        if any(not c.isspace() and c if isinstance(c, str) else id(c) in filled for c in node.children):
            filled.add(id(node))
            if separable(node) if node.inside or node.kept else not node.protects and node.name not in {"#root", "html", "body"}:
                out[node.hash] = None
    return list(out)


def content(root: Root, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of what is left, one per line."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            if text := SPACE.sub(" ", "".join(held)).strip():
                blocks.append(text)
            held.clear()

    def walk(top: Node, of: Node | None) -> None:
        todo: list = [(top, of)]
        while todo:
            node, part = todo.pop()
            if node is None:  # the end of a block
                flush()
            elif isinstance(node, str):
                held.append(node)
            elif not node.noise:
                if node.hash in template:
                    if separable(node) and 2 * node.size <= part.size if part else node.name not in {"#root", "html", "body"}:
                        continue
                if node.name in BLOCK:
                    flush()
                    todo.append((None, None))
                todo += [(c, part or (c if not isinstance(c, str) and c.kept else None)) for c in reversed(node.children)]

    def outermost(name: str | None, anywhere: bool = False) -> list[Node]:
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.noise and not anywhere:
                continue
            if node.kept and (node.name == name or name is None):
                out.append(node)
            elif node.protects:
                todo += [c for c in reversed(node.children) if not isinstance(c, str)]
        return out

    # The parts of a page that has none but in noisy elements are what it has.
    for part in outermost("article") or outermost(None) or outermost("article", True) or outermost(None, True) or [root]:
        walk(part, part if part.kept else None)
    flush()
    return "\n".join(blocks)


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, host, page in zip(batch["page_key"], batch["host"], batch["html"]):
            root = parse(page)
            hashes(root)
            rows.append((key, host, open_subtrees(root)))
        yield pd.DataFrame(rows, columns=["page_key", "host", "subtrees"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_id, url, page, template in zip(batch["page_id"], batch["url"], batch["html"], batch["template"]):
            root = parse(page)
            if template is not None and len(template):
                hashes(root)
            text = content(root, set() if template is None else set(np.asarray(template).tolist()))
            rows.append((page_id, url, text, len(text)))
        frame = pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars"])
        frame["page_id"] = frame["page_id"].astype("Int64")
        yield frame


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    The first pass cuts only hashes, distinct for each page, to the shared folder (a host is told by a hash too); counts per (host, hash) are summed in the tasks
    first, so a host with a third of all pages is no single task's work. Rows that repeat page_id and html are one page.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    rows = rows.withColumn("page_key", F.xxhash64("page_id", "html"))
    hashed = cut(rows.select("page_key", "host", "html").mapInPandas(_subtrees, "page_key long, host long, subtrees array<long>"))
    trees = hashed.select("page_key", "host", F.explode("subtrees").alias("subtree"))
    sizes = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = trees.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    template = (
        counted.where(F.col("n") >= least_pages).join(sizes, "host")
        .where(F.col("n") >= least_share * F.col("pages")).select("host", "subtree")
    )
    of_page = trees.join(template, ["host", "subtree"]).groupBy("page_key").agg(F.collect_set("subtree").alias("template"))
    both = rows.select("page_id", "url", "html", "page_key").join(of_page, "page_key", "left")
    return both.select("page_id", "url", "html", "template").mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
