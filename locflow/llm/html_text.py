"""Operator 8: main text of a web page by composite text density.

Every page becomes a small tree of its elements. Parts that are never
article text (menus, headers and footers of the page, forms, scripts, styles,
hidden parts) are cut off by element or role. Sidebars, notices, adverts, reader
comments and the like are known by the words of their class and id; the words
are weighed against the text (see ``settle``). For each remaining node the
density is its characters per tag, adjusted for links:

    density = C / T * log(C / LC * T / LT) / log(log(C / NC * LC + LB / CB * C + e))

with C characters, T tags, LC and LT those within links, NC characters
outside links, and CB, LB those of the body (an absent count is 1). A node's
sum is the sum of its children's densities. The threshold is the smallest
density on the path from the node of the largest sum to the body. The subtree
of the largest sum is selected and widened along its path: from a paragraph to
the element that holds it, then to the last ancestor with another part of the
text: an element that reaches the threshold and holds a sum of at least a
quarter of the selected subtree's densest child (or, with nearly no links, half
of it, whatever its own density). In elements that only arrange
others or hold the whole page, other elements are left out; paragraphs,
headings and lists that are not mostly links, and sections or articles beside
one that is kept, stay. A main element bounds the widening, an article does
unless another article beside the path is such a part; inside them the path is
followed up to the bound, and an article is taken whole. All blocks of what is
selected are returned.

A page is one row and its tree lives only while it is handled: a map without
shuffle, memory bounded by one page; a lost task is run again. Scanning is
linear in the page: no element search goes over the open elements unless it
closes them.

Defined cases: a null or empty page gives an empty text and 0 characters;
null ids and urls are kept; unclosed or stray tags never fail; repeated rows
give equal rows; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import heapq
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import pieces

BLOCK_CHARS = 1 << 20

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|"
                   r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[a-z]+|[0-9]+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")

# Fixed values of the HTML standard: elements without content, elements of raw text, elements that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
search section summary table tbody td tfoot th thead tr ul""".split())
ENDS_PARAGRAPH = BLOCK - frozenset("br caption td th tr tbody thead tfoot option optgroup legend html body".split())
# An element that starts ends these open ones, up to the element named after them.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
          "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)),
          "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select", "datalist"))}

# Elements and roles of what is not article text, and class or id words that speak against it.
CUT_TAGS = frozenset("""head nav footer aside form script style template iframe object embed svg canvas annotation
annotation-xml audio video button select input textarea datalist dialog menu title search xmp noembed noframes""".split())
CUT_ROLES = frozenset("""navigation banner contentinfo complementary search alert alertdialog dialog menu menubar
toolbar status tooltip form""".split())
CUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors
promo promos promotion promoted nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar sidebars aside
footer masthead cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter
subscribe subscription signup login share sharing social related recommended recommendations trending widget widgets
comment comments commentlist disqus replies respond reply pagination pager toolbar skip hidden""".split())
# A word after one of these says what an element has or lacks, not what it is.
ABOUT = frozenset("with has have no not without show hide enable enabled disable".split())
READERS = frozenset("comment comments commentlist disqus replies respond reply".split())
# Words that say a listed word's form or place; any other word after a listed one (related-work) makes it a mere hint.
FORMS = frozenset("""area badge bar block body bottom box btn button buttons card cards center col column container
content contents desktop entries entry field footer form grid group header heading holder icon icons inner item items
label left link links list lists message mobile news outer panel post posts primary region right row secondary section
slot small sticky stories story text tile tiles title top unit wrap wrapper zone""".split())
HINT, NAMED, OF_READERS = 1, 2, 3
# What the text of an element named so counts for against the rest of the page.
TRUST = {NAMED: 1 / 4, OF_READERS: 1 / 16}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead table ul ol menu dl figure "
                       "figcaption caption hr br address a b i em strong span u s small big font sub sup code q cite "
                       "abbr mark time label button math".split())

PART = 4    # another part of the text has a sum of at least this fraction of the densest child of the selected subtree


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "total",
                 "peak")

    def __init__(self, tag, parent, cut, doubt=0):
        self.tag, self.parent, self.cut, self.doubt = tag, parent, cut, doubt
        self.parts: list = []       # texts and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = self.peak = 0.0


def doubt_of(name: str, unwanted: frozenset) -> int:
    """What one class or id says against its element being article text."""
    words = WORD.findall(name)
    listed = [w in unwanted and (not k or words[k - 1] not in ABOUT) for k, w in enumerate(words)]
    if True not in listed:
        return 0
    last = len(words) - 1 - listed[::-1].index(True)
    if all(w in FORMS or w.isdigit() for w in words[last + 1:]):
        return OF_READERS if words[last] in READERS else NAMED
    return HINT


def judge(tag: str, attributes: str, in_article: bool, in_paragraph: bool = False) -> tuple[bool, int]:
    """Whether an element can't be article text, and the doubt that its class and id words raise.

    A button in a paragraph is a word of it, and a ``menu`` in an article a list; what stands for scripts that don't
    run (``noscript``) is in doubt like an element named so.
    """
    if tag in CUT_TAGS and not (tag == "button" and in_paragraph or tag == "menu" and in_article) or (
            tag == "header" and not in_article):
        return True, 0
    if tag == "noscript":
        return False, NAMED
    if not attributes or tag in ("html", "body", "main"):
        return False, 0
    unwanted = READERS if tag == "article" and not in_article else CUT_WORDS
    doubt = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name in ("class", "id"):
            doubt = max(doubt, *(doubt_of(one, unwanted) for one in value.split()), 0)
        elif name == "hidden" or name == "role" and value in CUT_ROLES or name == "aria-hidden" and value == "true" \
                or name == "style" and UNSEEN.search(value):
            return True, 0
    return "hidden" in attributes and "hidden" in ATTRIBUTE.sub(" ", attributes).replace("/", " ").split(), doubt


def parse(page: str) -> Node:
    """The page's tree; tolerant of unclosed and stray tags."""
    root = Node("html", None, False)
    open_nodes, places = [root], {"html": [0]}        # the open elements, and by tag where they stand among them
    articles, at, n = 0, 0, len(page)

    def nearest(tags):
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, until=()):
        """End the nearest open element of these tags, with all inside it, unless one of ``until`` is nearer."""
        nonlocal articles
        found = nearest(tags)
        if not found or until and nearest(until) > found:
            return
        while len(open_nodes) > found:
            node = open_nodes.pop()
            places[node.tag].pop()
            articles -= node.tag in ("article", "main")

    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            open_nodes[-1].parts.append(page[at:start])
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                open_nodes[-1].parts.append(html.escape(m.group()[9:].removesuffix("]]>"), False))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in ("html", "body"):
                close((tag,))
            continue
        if not m.group(4) and at < n:      # a quote that never ends: go on after the next >
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
        if tag in ("html", "body") and (tag == "html" or places.get("body")):
            continue
        if places.get("p") and tag in ENDS_PARAGRAPH:
            close(("p",))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if places.get("head") and tag == "body":
            close(("head",))
        node = Node(tag, open_nodes[-1], *judge(tag, m.group(3), articles > 0, bool(places.get("p"))))
        open_nodes[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end:
                node.parts.append(page[at:end.start()])
                close_tag = page.find(">", end.end())
                at = close_tag + 1 if close_tag >= 0 else n
            else:
                at = n
        elif tag not in VOID and not (m.group(3).endswith("/") and tag in ("svg", "path", "g")):
            places.setdefault(tag, []).append(len(open_nodes))
            open_nodes.append(node)
            articles += tag in ("article", "main")
    return root


def in_order(root: Node) -> list[Node]:
    """The nodes that are not cut off, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.cut)
    return out


def count(nodes: list[Node]) -> None:
    """Characters and tags of each subtree."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for x in node.parts:
            if isinstance(x, str):
                node.chars += sum(map(len, x.split()))
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1


def weigh(nodes: list[Node], share: float) -> None:
    """Densities, their sums over children, and the largest of these below each node; ``share`` is the page's of links."""
    for node in reversed(nodes):
        node.density = node.total = node.peak = 0.0
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0 + 1e-9)) / math.log(base + 1e-9) \
                if base > 1 + 1e-6 else float(c) / t
        for x in node.parts:
            if not isinstance(x, str) and not x.cut:
                node.total += x.density
                node.peak = max(node.peak, x.peak)
        node.peak = max(node.peak, node.total, node.density)


def link_share(node: Node) -> float:
    return node.link_chars / max(node.chars, 1)


def settle(root: Node) -> None:
    """Cut the elements whose class and id words speak against them and whose text does not outweigh the words.

    The text of such an element, without nested ones, counts by its largest
    density sum, times its share outside links, times the trust in the words;
    a main element, a first heading or (but for readers' words) an article
    within it counts for it, and against it where only the rest of the page
    has one. It stays if that reaches the largest sum of the rest, so an
    element round the page stays; the weightiest is settled first and joins
    the rest. A mere hint cuts what is mostly links, unless it holds the
    largest sum.
    """
    nodes = in_order(root)
    if not any(x.doubt for x in nodes):
        return
    count(nodes)
    share = link_share(root)
    doubtful = [x for x in nodes if x.doubt >= NAMED and x.chars]
    inner: dict[Node | None, list] = {}
    holder: dict[Node, Node | None] = {root: None}      # the doubtful element round each node
    for x in nodes[1:]:
        up = x.parent if x.parent.doubt >= NAMED else holder[x.parent]
        holder[x] = up
    for x in doubtful:
        x.cut = True
        inner.setdefault(holder[x], []).append(x)

    def look(top):
        """The largest sum, whether there is a main or first heading, and whether an article, in the own text of ``top``."""
        region = in_order(top)
        count(region)
        weigh(region, share)
        tags = {x.tag for x in region[1:] if x.chars}
        return top.peak * (1 - link_share(top)), bool(tags & {"main", "h1"}), "article" in tags

    best, head, article = look(root)
    found, value = {}, {}
    for x in reversed(doubtful):
        found[x] = own, own_head, own_article = look(x)
        sign = own_head or own_article and x.doubt == NAMED
        rest = head or article and x.doubt == NAMED
        own *= 1 if sign == rest and not sign else 4 if sign and rest else 16 if sign else 1 / 4
        value[x] = TRUST[x.doubt] * max([own, *(value[y] for y in inner.get(x, ()))])
    order = {x: k for k, x in enumerate(doubtful)}
    heap = [(-value[x], order[x], x) for x in inner.get(None, ())]
    heapq.heapify(heap)
    while heap:
        worth, _, x = heapq.heappop(heap)
        if -worth >= best:
            x.cut = False
            best = max(best, found[x][0])
            for y in inner.get(x, ()):
                heapq.heappush(heap, (-value[y], order[y], y))

    hints = [x for x in nodes if x.doubt == HINT]
    if hints:
        nodes = in_order(root)
        count(nodes)
        weigh(nodes, link_share(root))
        for x in hints:
            x.cut = x.chars > 0 and 2 * x.link_chars >= x.chars and x.peak < root.peak


def layout(node: Node) -> bool:
    """Whether the element arranges others: less than half of its characters stand in it or in its paragraphs."""
    own = sum(sum(map(len, x.split())) if isinstance(x, str) else x.chars for x in node.parts
              if isinstance(x, str) or (not x.cut and x.tag in PARAGRAPHS))
    return 2 * own < node.chars


def leave_out(root: Node, path: set[Node], top: Node, is_part) -> None:
    """Cut what is no part of the text below ``root``, as far as elements only arrange others or hold the whole page."""
    stack = [root]
    while stack:
        node = stack.pop()
        arranges = layout(node)
        if node.tag == "article" or not (arranges or node.chars == top.chars and node.tag != "main"):
            continue
        parts = [x for x in node.parts if isinstance(x, Node) and not x.cut and x.chars]
        tags = {x.tag for x in parts if x in path or is_part(x)} & {"article", "section"}
        begun = False       # a paragraph came before: lists of links are no menus any more
        for x in parts:
            plain = 2 * x.link_chars < x.chars
            if x.tag in PARAGRAPHS:
                begun = begun or x.tag == "p" and plain
                x.cut = not (plain or x in path or begun and not arranges)
            elif x in path or is_part(x) or x.tag in tags and plain:
                stack.append(x)
            else:
                x.cut = not (plain and x.tag in ("header", "hgroup"))


def select(nodes: list[Node], top: Node) -> Node:
    """The subtree of the article; what lies beside the path to it and is no part of the text is cut."""
    best = max((x for x in nodes if x is top or x.parent is not None), key=lambda x: x.total)
    path = [best]
    while path[-1] is not top and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    densest = max((x.density for x in best.parts if isinstance(x, Node) and not x.cut), default=best.density)

    def is_part(x):
        if x.density >= threshold:
            return PART * x.peak >= densest
        return 2 * x.peak >= densest and 10 * x.link_chars < x.chars    # much plain text, spread over many tags

    at = 0
    while at + 1 < len(path) and path[at].tag in PARAGRAPHS:
        at += 1
    for tag in ("article", "main"):         # inside one of these, the whole of it may be text
        at = max([at, *(k for k, x in enumerate(path) if x.tag == tag)])
    for k in range(at + 1, len(path)):      # as far as other parts of the text lie
        bound = path[at].tag
        if bound == "main":
            break
        if any(isinstance(x, Node) and not x.cut and x is not path[k - 1] and x.tag not in PARAGRAPHS
               and (bound != "article" or x.tag == "article") and is_part(x) for x in path[k].parts):
            at = k
    leave_out(path[at], set(path[:at + 1]), top, is_part)
    return path[at]


def blocks(root: Node) -> list[str]:
    """The texts of the subtree's blocks in page order, white space made single."""
    out, line = [], []

    def flush():
        words = html.unescape("".join(line)).split()
        if words:
            out.append(" ".join(words))
        line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.cut:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str) -> str:
    """The article's text, one block a line."""
    root = parse(page)
    settle(root)
    nodes = in_order(root)
    top = next((x for x in nodes if x.tag == "body"), root)
    count(nodes)
    weigh(nodes, link_share(top))
    return "\n".join(blocks(select(nodes, top)))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: the id, the url, ``text`` and ``n_chars`` (its code points)."""
    source = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("id").type
            for rows in pieces(batch, ("id", "url", "html"), lambda r: len(r[2]), BLOCK_CHARS):
                texts = [main_text(r[2]) for r in rows]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r[0] for r in rows], id_type), "url": pa.array([r[1] for r in rows], pa.string()),
                    "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    out = source.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
