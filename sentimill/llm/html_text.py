"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each paragraph earns points for its length and its commas and
passes them to its parent in full and to all further ancestors in falling shares; a container's points
are discounted by the part of its text that stands in links, and shifted by what its tag and its class
say. The best container is kept with those siblings that score near it or read like prose. What is
left inside - menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments - is cut out, and the text is read block by block.

Class words and forms are cut only where the page's prose says so too: an element that holds most of
it stays, whatever it is called. A page that comes out empty is read again without class words.
"""

from __future__ import annotations

import html as charrefs
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimill.llm.arrow import map_texts

# Element names by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select canvas audio video".split())
BLOCK = frozenset(
    "html body main article section div p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "figure figcaption address fieldset form header footer nav aside hr details summary center hgroup menu dialog search".split()
)
CUT = frozenset("nav footer aside form button fieldset dialog menu search head input label noscript template iframe".split()) | RAW
CLOSES_P = BLOCK - {"html", "body"}
#: An opening tag ends an open element of these names, looked for up to one of the names after the colon.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("article aside body div section main td th table li blockquote header footer nav form html".split())

#: Class and id words of what is not the article (but not "with-sidebar", "has-header" and the like, which speak of the page), of comments, and of what is the article.
NOISE = re.compile(
    r"(?<!\bwith[_-])(?<!\bhas[_-])(?<!\bno[_-])(?<!\bwithout[_-])(?<!\bis[_-])(?:(?<=[\s_-])|^)(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-?bar|footer|masthead|header|"
    r"comments?|commentlist|respond|disqus|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|"
    r"related|recommend\w*|widget|pagination|pager|toolbar|skip|login|search)(?=$|[\s_\d-])"
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|disqus)(?=$|[\s_\d-])")
BODYISH = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|hentry|blog|page)(?=$|[\s_\d-])")
#: A tag is its name and attributes up to ">"; quotes count only after "=". What never closes ends at the next ">" (UNCLOSED).
MARKUP = re.compile(r"<(?:!--|[!?/a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|(?![\s\"'])|(?=>)))*+)>")
UNCLOSED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WHITE = re.compile(r"\s+")
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
LEAST_PARAGRAPH = 25
#: Characters of prose outside a noisy container up to which it is the page itself.
NEXT_TO_NOTHING = 100
#: Elements nested deeper are hung on the last open one, as browsers do; it keeps every step's work bounded.
DEEPEST = 512


class Node:
    __slots__ = ("depth", "heads", "label", "links", "name", "parent", "parts", "points", "prose", "runs", "size")

    def __init__(self, name: str, parent: Node | None, label: str = ""):
        self.name, self.parent, self.label = name, parent, label
        self.parts: list[Node | str] = []
        self.points = 0.0
        self.size = self.links = self.prose = self.runs = self.heads = 0
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """The element tree; open ends, stray ends and broken tags never fail. Contents of RAW elements are skipped."""
    root = here = Node("html", None)
    at, n = 0, len(page)
    while at < n:
        found = MARKUP.search(page, at)
        end = found.start() if found else n
        if end > at:
            here.parts.append(page[at:end])
        if not found:
            break
        if found[0] in ("<!--", "<!", "<?"):
            close = "-->" if found[0] == "<!--" else ">"
            stop = page.find(close, end + 2)
            at = n if stop < 0 else stop + len(close)
            continue
        m = TAG.match(page, end) or UNCLOSED.match(page, end)
        if not m:  # "</>", "</3", or no ">" is left at all
            stop = page.find(">", end)
            if stop < 0:
                here.parts.append(page[end:])
                break
            at = stop + 1 if page[end + 1] == "/" else end + 1
            if at == end + 1:
                here.parts.append("<")
            continue
        at, name = m.end(), m[2]
        name = name.lower()
        if m[1]:
            node = here
            while node is not None and node.name != name:
                node = node.parent
                if node is not None and name not in BLOCK and node.name in SCOPE:
                    node = None  # an inline end tag doesn't reach out of its block
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if name in ("html", "body"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in CLOSES_P:
            here = _closed(here, {"p"}, SCOPE)
        if name in IMPLIED:
            here = _closed(here, *IMPLIED[name])
        attributes = m[3]
        label = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower() if "=" in attributes else ""
        node = Node(name, here, label)
        here.parts.append(node)
        if name not in VOID and not attributes.endswith("/") and node.depth < DEEPEST:
            here = node
    return root


def _closed(here: Node, names, until) -> Node:
    """Where the next element goes after the nearest open one of ``names`` is closed."""
    node = here
    while node is not None and node.name not in until:
        if node.name in names:
            return node.parent
        node = node.parent
    return here


def noisy(node: Node) -> bool:
    return bool(node.label and NOISE.search(node.label) and not BODYISH.search(node.label))


def _measure(order: list[Node]) -> None:
    """Characters of prose (runs of text outside links) in every element, and how many such runs; comments and what is always cut count for nothing above them."""
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                size = len(x.strip())
                if size > LEAST_PARAGRAPH:
                    node.prose += size
                    node.runs += 1
            elif x.name != "a" and (x.name not in CUT or x.name == "form") and not COMMENTS.search(x.label):
                node.prose += x.prose
                node.runs += x.runs
                node.heads += x.heads + (x.name in ("article", "main", "h1"))


def _prune(root: Node, by_class: bool) -> list[Node]:
    """All elements in page order, those that can't hold article text cut from the tree."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    _measure(order)

    def unwanted(x: Node) -> bool:
        if x.name == "header" and not _within_article(x):
            return True
        if 2 * x.prose > root.prose and x.name not in CUT - {"form"} and not COMMENTS.search(x.label) and (x.heads or x.runs >= 3 and root.prose - x.prose <= NEXT_TO_NOTHING):
            return False  # it holds the article's own element, or next to nothing stands outside it: an odd name, no noise
        return x.name in CUT or by_class and noisy(x)

    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.parts = [x for x in node.parts if isinstance(x, str) or not unwanted(x)]
        stack.extend(x for x in reversed(node.parts) if not isinstance(x, str))
    return order


def _within_article(node: Node) -> bool:
    """A header inside an article carries the article's headline, unless it holds none."""
    up = node.parent
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    return up is not None and any(not isinstance(x, str) and x.name in ("h1", "h2", "hgroup") for x in node.parts)


def _own_text(node: Node) -> str:
    """The text of a paragraph with that of the inline elements in it."""
    return "".join(x if isinstance(x, str) else "" if x.name in BLOCK else _own_text_flat(x) for x in node.parts)


def _own_text_flat(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.name not in BLOCK:
            stack.extend(reversed(x.parts))
    return "".join(out)


def score(order: list[Node]) -> None:
    """Points of every element; sizes of its text and of what is in links."""
    for node in order:
        if node.name in PARAGRAPHS or node.name in ("div", "section", "article", "main") and any(isinstance(x, str) and len(x) > LEAST_PARAGRAPH for x in node.parts):
            text = WHITE.sub(" ", _own_text(node)).strip()
            if len(text) < LEAST_PARAGRAPH:
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            up, share = (node.parent, 1.0) if node.name in PARAGRAPHS else (node, 1.0)
            level = 0
            while up is not None:
                up.points += points * share
                level += 1
                share = 1 / (2 * level) if level < 2 else 1 / (3 * level)
                up = up.parent
    for node in reversed(order):
        node.size = sum(len(x) if isinstance(x, str) else x.size for x in node.parts)
        node.links = node.size if node.name == "a" else sum(x.links for x in node.parts if not isinstance(x, str))
    for node in order:
        prior = {"article": 25, "main": 25, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3}.get(node.name, 0)
        if node.label:
            prior += 25 * bool(BODYISH.search(node.label)) - 25 * bool(NOISE.search(node.label) or COMMENTS.search(node.label))
        node.points = (node.points + prior * (node.size > 0)) * (1 - node.links / node.size if node.size else 0)


def pick(order: list[Node]) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    holders = [x for x in order if x.name in BLOCK and x.name not in ("p", "hr") and x.size]
    if not holders:
        return order[:1]
    best = max(holders, key=lambda x: x.points)
    if best.points <= 0:
        return order[:1]
    if best.parent is None:
        return [best]
    least = max(10.0, best.points * 0.2)
    kept: list[Node] = []
    headings: list[Node] = []  # lower headings go with what follows them
    for x in best.parent.parts:
        if isinstance(x, str):
            continue
        density = x.links / x.size if x.size else 0
        prose = x.name == "p" and (x.size > 80 and density < 0.25 or 0 < x.size <= 80 and density == 0 and "." in _own_text(x))
        heading = x.name in ("h1", "h2") and density < 0.2
        alike = x.points + (best.points * 0.2 if x.label and x.label == best.label else 0) >= least
        listing = x.name in ("ul", "ol", "dl", "table") and x.size > LEAST_PARAGRAPH and density < 0.25
        if x.name in ("h3", "h4", "h5", "h6") and x.size and density < 0.2:
            headings.append(x)
        elif x is best or prose or heading or listing or alike and x.name not in ("ul", "ol", "dl", "table"):
            kept += [*headings, x]
            headings = []
        elif x.size and x.name != "hr":
            headings = []
    return kept


def read(nodes: list[Node]) -> str:
    """Text block by block: references decoded, white space within a block one space, blocks joined by an empty line."""
    blocks, line = [], []

    def flush():
        text = WHITE.sub(" ", charrefs.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif x.name in BLOCK:
                flush()
                stack.append(None)
                stack.extend(reversed(x.parts))
            else:
                stack.extend(reversed(x.parts))
        flush()
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    """The article of one page; empty for null, empty or textless pages."""
    if not page:
        return ""
    text = ""
    for by_class in (True, False):
        order = _prune(parse(page), by_class)
        score(order)
        text = read(pick(order))
        if text or not order[0].size and not by_class:
            break
    return text


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A map over the rows: no shuffle, memory of one Arrow batch and one page's tree. Null and empty
    html give empty text; repeated rows and null ids are handled row by row; other columns are ignored.
    """

    def start():
        return lambda texts: {"text": pa.array([main_text(t) for t in texts], pa.string())}

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_texts(rows, "html", "text string", start).withColumn("n_chars", F.length("text").cast("long"))
