"""Main text of web pages by composite text density over the DOM.

A page is tokenised in one pass by the attribute, comment and raw-text rules of
HTML and built into a tree with the usual implied end tags and void elements.
Every node gets its composite text density: characters per tag, damped where
many of the characters or tags are links; line breaks are no tags.  A node's
sum adds its children's densities and the length of its own text.  The block
that holds the node of the largest sum is article text as a whole.  The least
density on the path from there up to the body is the threshold: what hangs off
that path is article text too if its density reaches ``SHARE`` of the
threshold, or if it holds the page's title (``h1``) outside of links; if the
body itself holds the largest sum, what is mostly links goes by the threshold.

Taken out before are scripts, styles and other content that is no text, hidden
elements (``hidden``, ``aria-hidden``, ``display: none``), elements that are
never article text (menus, footers, forms, dialogs, a header without a heading
of the article), and elements whose class, id or role names such a part, notice,
advert or reader comments; a heading never goes by its names, and a paragraph
only by a whole name.  Names and elements do not decide where the article is:
``article`` and ``main`` count as any other block.

Null or empty html gives empty text, as does a page without a body of text.
Long pages are taken whole in linear time, nesting deeper than ``DEEPEST`` is
flattened, unclosed and stray tags are repaired, a tag that the page's end cuts
off is no text.  Of nodes of equal sums the first counts.  Repeated rows give
repeated results, an empty table an empty table.  Other columns pass through;
an existing column of the output's name is replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import small_batches, table

#: Share of the threshold that what hangs off the path to the body must reach.
SHARE = 0.2
#: Open elements beyond which further ones are not nested.
DEEPEST = 256

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
NO_TEXT = frozenset("head template svg canvas object audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center details div html main section td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
OUTSIDE = frozenset("nav aside footer form button dialog menu fieldset label".split())
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
LISTS = frozenset("ul ol dl table select".split())
SCOPE = frozenset("ul ol dl table body html article section main div td th".split())
# Words of class, id or role that name what is not the article.
_NOT_ARTICLE = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|"
    r"popup|promo\w*|related|replies|reply|search|share|sharing|sidebar|side|skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|alert|alertdialog|dialog|respond|paywall|gdpr)"
)
NAMES_PART = re.compile(rf"(?:^|[\s_-]){_NOT_ARTICLE}(?:$|[\s_-])", re.I)
NAMES_WHOLE = re.compile(rf"(?:^|\s){_NOT_ARTICLE}(?:$|\s)", re.I)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
BLANK = re.compile(r"[\s/]*")
HIDING = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"[\s\x00]+")


class Node:
    __slots__ = ("tag", "kids", "chars", "tags", "link_chars", "link_tags", "density", "sum", "names", "hidden", "titled", "headed")

    def __init__(self, tag: str):
        self.tag, self.names, self.hidden, self.kids = tag, "", False, []


def _attributes(source: str, at: int, node: Node) -> int:
    """Read a tag's attributes into the node; where the tag ends, or 0 if the page ends first."""
    n = len(source)
    while True:
        at = BLANK.match(source, at).end()
        if at >= n:
            return 0
        if source[at] == ">":
            return at + 1
        m = ATTRIBUTE.match(source, at)
        at, name = m.end(), m[1].lower()
        if name in ("class", "id", "role"):
            node.names += " " + (m[2] or m[3] or m[4] or "")
        elif name == "hidden" or name == "aria-hidden" and (m[2] or m[3] or m[4] or "").lower() == "true" or name == "style" and HIDING.search(m[2] or m[3] or m[4] or ""):
            node.hidden = True


def _past(source: str, what: str, at: int) -> int:
    found = source.find(what, at)
    return len(source) if found < 0 else found + len(what)


class Builder:
    """The tree of the tags given so far; strings among ``kids`` are text with character references decoded."""

    def __init__(self):
        self.root = Node("html")
        self.open, self.counts = [self.root], Counter()

    def close_from(self, i: int) -> None:
        for x in self.open[i:]:
            self.counts[x.tag] -= 1
        del self.open[i:]

    def close_nearest(self, tags, stops) -> None:
        if any(self.counts[t] for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    return self.close_from(i)
                if self.open[i].tag in stops:
                    return None
        return None

    def text(self, text: str) -> None:
        self.open[-1].kids.append(entities.unescape(text) if "&" in text else text)

    def start(self, node: Node) -> None:
        if node.tag in CLOSES_P:
            self.close_nearest(("p",), SCOPE)
        if node.tag in CLOSED_BY:
            self.close_nearest(CLOSED_BY[node.tag], LISTS)
        self.open[-1].kids.append(node)
        if node.tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)
            self.counts[node.tag] += 1

    def end(self, tag: str) -> None:
        if self.counts[tag]:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    return self.close_from(i)
                if tag not in BLOCK and self.open[i].tag in BLOCK:  # a stray inline end tag closes no block
                    return None
        return None


def parse(source: str) -> Node:
    """Tree below the document."""
    tree, at, n, text_from = Builder(), 0, len(source), 0
    while at < n:
        less = source.find("<", at)
        if less < 0:
            break
        after = source[less + 1 : less + 2]
        closing = after == "/" and TAG_NAME.match(source, less + 2)
        opening = TAG_NAME.match(source, less + 1)
        if not (closing or opening or after in ("!", "?") and after or after == "/"):
            at = less + 1  # a lone less-than sign is text
            continue
        if less > text_from:
            tree.text(source[text_from:less])
        if closing or opening:
            node = Node((closing or opening).group().lower())
            end = _attributes(source, (closing or opening).end(), node)
            if not end:
                return tree.root
            if closing:
                tree.end(node.tag)
            elif node.tag in RAW:
                found = re.compile(rf"</{re.escape(node.tag)}(?=[\s/>])", re.I).search(source, end)
                end = _past(source, ">", found.end()) if found else n
            elif node.tag not in ("html", "body"):
                tree.start(node)
        elif source.startswith("<!--", less):
            end = _past(source, "-->", less + 4 - 2 * source.startswith("<!-->", less))
        elif source.startswith("<![CDATA[", less):
            end = _past(source, "]]>", less)
            tree.text(source[less + 9 : end].removesuffix("]]>").replace("&", "&amp;"))
        else:
            end = _past(source, ">", less)
        at = text_from = end
    if text_from < n:
        tree.text(source[text_from:])
    return tree.root


def _walk(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out = [root]
    for x in out:
        out.extend(k for k in x.kids if isinstance(k, Node))
    return out


def prune(root: Node) -> None:
    """Take subtrees out that cannot be article text."""
    for x in reversed(_walk(root)):
        kids = [k for k in x.kids if isinstance(k, Node)]
        x.headed = x.tag in HEADING or any(k.headed for k in kids)
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or not _outside(k, depth)]
        todo.extend((k, depth + 1) for k in node.kids if isinstance(k, Node))


def _outside(node: Node, depth: int) -> bool:
    if node.hidden or node.tag in OUTSIDE or node.tag in NO_TEXT:
        return True
    if node.tag == "header":  # of the page, or of the article with its title
        return not depth or not node.headed
    if not node.names or node.tag in HEADING or node.tag in ("article", "main"):
        return False
    return bool((NAMES_WHOLE if node.tag in ("p", "blockquote", "pre") else NAMES_PART).search(node.names))


def measure(root: Node) -> list[Node]:
    """Composite text density of every node, and the sum of its children's."""
    nodes = _walk(root)
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.titled = x.tag == "h1"
        for k in x.kids:
            if isinstance(k, Node):
                x.chars += k.chars
                x.tags += k.tags + (k.tag not in ("br", "wbr", "hr"))
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
                x.titled |= k.titled
            else:
                x.chars += len(SPACE.sub("", k))
        if x.tag == "a":
            x.link_chars = x.chars
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for x in nodes:
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, body_chars, body_links)
    for x in nodes:
        x.sum = sum(k.density if isinstance(k, Node) else len(SPACE.sub("", k)) for k in x.kids)
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Characters per tag, damped by the share of links in the node and in the page."""
    plain = chars - link_chars
    if not plain:
        return 0.0
    tags, links = max(tags, 1), max(link_tags, 1)
    base = math.e + chars * link_chars / plain + body_links * chars / body_chars
    return chars / tags * max(0.0, math.log(chars * tags / (max(link_chars, 1) * links)) / math.log(base))


def article(root: Node) -> Node:
    """The tree cut down to the article's text."""
    nodes = measure(root)
    best = max(nodes, key=lambda x: x.sum)
    up = {id(k): x for x in nodes for k in x.kids if isinstance(k, Node)}
    while best.tag not in CONTAINER and id(best) in up:
        best = up[id(best)]
    path = [best]
    while id(path[-1]) in up:
        path.append(up[id(path[-1])])
    threshold = SHARE * min(x.density for x in path)
    on = {id(x) for x in path}
    if best is root:  # nothing wraps the article: what is mostly links goes
        root.kids = [k for k in root.kids if isinstance(k, str) or k.density >= threshold or k.link_tags < 2 or 2 * k.link_chars < k.chars]
    for x in path[1:]:
        x.kids = [k for k in x.kids if isinstance(k, str) or id(k) in on or k.tag in VOID or k.density >= threshold or k.titled and 2 * k.link_chars < k.chars]
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the node's blocks in page order, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(x.kids))
        else:
            todo.extend(reversed(x.kids))
    flush()
    return out


def main_text(source: str | None) -> str:
    """The article's blocks joined by one space."""
    if not source:
        return ""
    root = parse(source)
    prune(root)
    return " ".join(blocks(article(root)))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of its html."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts = pa.array([main_text(x.as_py()) for x in batch.column(at(html))], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in keep] + [texts], names=[*keep, out])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.selectExpr("page_id", "url", "text", "CAST(length(text) AS BIGINT) AS n_chars")


QUERIES = {"op3_html_extraction": op3_html_extraction}
SQL: dict[str, str] = {}
