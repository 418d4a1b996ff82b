"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of tags from the root. Per path, text length and
punctuation are summed and divided by the number of its nodes. Along the page these two ratios are
smoothed, then fused by multiplication; nodes above the threshold are content. Menus and link lists
have paths of many short nodes without punctuation and stay below it.

The selected nodes point out the content element: the innermost one that holds nearly all of their
text, or the article around it. All of its blocks are returned, short ones as well, but for parts
that are no article text by their element or by their class, id or role: navigation, page headers
and footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>"
    r"|<[!?/][^>]*+>"
    r"|<(?:/?[a-zA-Z]|[!?])[^>]*+\Z",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of a page that are no article text.
_DROPPED = frozenset("head script style title template noscript nav header footer aside form button select option textarea input dialog menu svg canvas iframe object xmp noembed noframes".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_DROPPED_NAMES = frozenset(
    "nav navigation navbar menu menus breadcrumb breadcrumbs header masthead footer sidebar sidenav aside widget related "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe signup login share sharing social comment comments disqus respond reply replies pagination pager form".split()
)
_CONTENT_NAMES = frozenset("article main content post entry story body text".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_INLINE_SPACE = frozenset("br wbr img".split())
# A start tag of the key ends open elements of these kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div body html main td th".split())
# Blocks that hold running text, never the content element as such.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote tbody thead figcaption caption".split())


@dataclass
class Element:
    tag: str
    parent: int
    dropped: bool
    article: bool


@dataclass
class TextNode:
    element: int
    block: int
    text: str


def _no_article(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in _DROPPED:
        # The header of an article holds its heading.
        return not (tag == "header" and inside_article)
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    if _HIDDEN.search(_QUOTED.sub("", attrs)):
        return True
    for name, *values in _ATTR.findall(attrs):
        value = html.unescape("".join(values)).lower()
        name = name.lower()
        if name == "role" and value.strip() in _DROPPED_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = _NAME.findall(part)
                if not _DROPPED_NAMES.isdisjoint(words) and not (words[-1] in _CONTENT_NAMES and words[0] not in _DROPPED_NAMES):
                    return not (inside_article and words[-1] == "header")
        if name == "aria-hidden" and value == "true":
            return True
    return False


def read(page: str) -> tuple[list[Element], list[TextNode]]:
    """Elements and text nodes in page order; unclosed and misnested tags are put right as browsers do."""
    elements = [Element("", -1, False, False)]
    nodes: list[TextNode] = []
    stack = [0]
    block = 0  # number of the current block
    at = 0

    def add(raw: str) -> None:
        if raw:
            nodes.append(TextNode(stack[-1], block, html.unescape(raw)))

    def close(depth: int) -> None:
        nonlocal block
        for e in stack[depth:]:
            if elements[e].tag in _BLOCKS:
                block += 1
                break
        del stack[depth:]

    def open_of(kinds: frozenset[str] | set[str], scope: frozenset[str]) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in kinds:
                return depth
            if tag in scope:
                return 0
        return 0

    while found := _TOKEN.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if tag == "br":
                nodes.append(TextNode(stack[-1], block, " "))
            elif depth := open_of({tag}, frozenset() if tag in _SCOPES else _SCOPES - {"div"} if tag in _BLOCKS else _BLOCKS):
                close(depth)
            elif tag == "p":
                block += 1
            continue
        if tag in _INLINE_SPACE:
            nodes.append(TextNode(stack[-1], block, " " if tag == "br" else ""))
            continue
        if tag in _BLOCKS:
            if depth := open_of({"p"}, _SCOPES):
                close(depth)
            block += 1
        if tag in _CLOSES and (depth := open_of(_CLOSES[tag], _SCOPES - {"td", "th"} if tag in ("tr", "td", "th") else _SCOPES)):
            close(depth)
        above = elements[stack[-1]]
        attrs = found["attrs"] or ""
        dropped = above.dropped or _no_article(tag, attrs, above.article)
        if tag in _RAW:
            # Its content is text without markup, up to its own end tag.
            ending = _RAW[tag].search(page, at)
            at = ending.end() if ending else len(page)
            continue
        if tag in _VOID or tag == "hr":
            continue
        elements.append(Element(tag, stack[-1], dropped, above.article or tag in ("article", "main")))
        if attrs.endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(len(elements) - 1)
    add(page[at:])
    return elements, nodes


def _smooth(values: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian average along the page; at the ends over the part of the kernel that is there."""
    kernel = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]
    return np.convolve(values, kernel)[radius : radius + len(values)] / weight


def select(elements: list[Element], nodes: list[TextNode], strictness: float) -> list[TextNode]:
    """The text nodes whose smoothed and fused path ratio passes the threshold."""
    texts = [n for n in nodes if n.text.strip() and not elements[n.element].dropped]
    if not texts:
        return []
    paths: dict[int, int] = {}  # element to the number of its path
    names: dict[tuple[int, str], int] = {}

    def path(e: int) -> int:
        chain = []
        while e not in paths and e > 0:
            chain.append(e)
            e = elements[e].parent
        number = paths.get(e, 0)
        for e in reversed(chain):
            number = paths[e] = names.setdefault((number, elements[e].tag), len(names) + 1)
        return number

    of = np.array([path(n.element) for n in texts])
    length = np.array([len(n.text.strip()) for n in texts], dtype=float)
    marks = np.array([sum(map(n.text.count, ".,;:!?。、，！？")) for n in texts], dtype=float)
    number = np.bincount(of)
    with np.errstate(invalid="ignore"):
        text_ratio = (np.bincount(of, length) / number)[of]
        mark_ratio = (np.bincount(of, marks) / number)[of]
    fused = _smooth(text_ratio) * (1 + _smooth(mark_ratio))
    threshold = strictness * fused.std()
    chosen = [n for n, score in zip(texts, fused) if score >= threshold]
    return chosen or texts


def main_text(page: str | None, share: float = 0.9, strictness: float = 0.5) -> str:
    """The blocks of the main text, joined by an empty line; empty if there are none."""
    if not page:
        return ""
    elements, nodes = read(page)
    chosen = select(elements, nodes, strictness)
    if not chosen:
        return ""
    held = np.zeros(len(elements))
    for n in chosen:
        held[n.element] += len(n.text.strip())
    for e in range(len(elements) - 1, 0, -1):  # parents come first
        held[elements[e].parent] += held[e]
    # Going up from an innermost element, the first one that holds enough and can hold blocks.
    root = max((e for e in range(len(elements)) if held[e] >= share * held[0]), default=0)
    while root and (elements[root].tag in _LEAVES or elements[root].tag not in _BLOCKS):
        root = elements[root].parent
    above = root
    while above:
        if elements[above].tag in ("article", "main"):
            root = above
        above = elements[above].parent
    inside = [False] * len(elements)
    for e in range(len(elements)):
        inside[e] = e == root or (e > 0 and inside[elements[e].parent])
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if inside[n.element] and not elements[n.element].dropped:
            blocks.setdefault(n.block, []).append(n.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract(df: DataFrame, page: str = "html", out: str = "text", share: float = 0.9, strictness: float = 0.5) -> DataFrame:
    """Add the main text of ``page``: empty for a null or empty page and for one without text.

    ``share`` is the part of the selected text that the content element has to hold, ``strictness``
    the threshold in standard deviations of the fused ratio.
    """

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, share, strictness) for p in pages], dtype=object)

    return df.withColumn(out, run(F.col(page)))
