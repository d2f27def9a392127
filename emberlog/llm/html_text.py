"""Main text of web pages by tree scoring.

A page is read into a tree of its elements. Paragraph-like blocks pass points for their length and commas to their parent,
half to the grandparent and less further up; a container's points are discounted by its share of text in links, and those of an
<article> or <main> count BONUS times. The container of most points is the best one, whatever its name. Elements around it
that add nothing but headings are taken instead of it. Kept are the best container and, in page order, those of its siblings
that have SIBLING of its points, read like prose (paragraphs and headings), or share an <article> or <main> with it, unless
they are mostly links. Within them, all that is marked as menu, header, footer, sidebar, notice, advert, form or reader comment
goes, and all the rest stays. If such marks leave no text, only element names count as marks.

White space in a block becomes one space; blocks are joined by one space; character references are decoded. Null or empty
html gives an empty text, as do pages without text outside such marks. A tag that is never closed takes the rest of the page.
Repeated rows are read each for itself; an empty table gives an empty table; the added column replaces an input column of its
name. Work on one page is linear in its length.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.memory import small_batches

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An open element that a new one of these names ends, up to the element that holds both.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"})}
ENDS |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NEVER = frozenset("script style textarea title noscript iframe xmp template head nav header footer aside form button select datalist option input label svg math object canvas audio video dialog menu fieldset search".split())
#: Elements that a slash at the end of their tag doesn't close; of the others that HTML knows it only closes those of other kinds of markup.
OPENS = (RAW | NEVER | BLOCK) - {"svg", "math"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
#: Words in class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer header masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies reply discussion pager pagination widget search contentinfo complementary dialog form teaser teasers outbrain taboola skip".split()
)
SPARED = frozenset({"html", "body", "main"})
#: Marks that hold even around an article, and first words that say what an element goes with, not what it is.
FIRM = frozenset("comment comments commentlist disqus respond replies reply discussion related recommended recommendations teaser teasers".split())
WITH = frozenset("has with no without".split())
UNSEEN = frozenset("hidden visually-hidden is-hidden sr-only screen-reader-text".split())
LINKS_MOST = 0.33
#: Points of an article or main element count so much more; a sibling's points count at this share of the best container's.
BONUS, SIBLING = 1.5, 0.2
#: Elements that a paragraph which is open outside them isn't ended in.
SCOPES = frozenset("p td th button object table".split())

_TOKEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The rest of a tag. A quote counts after an equals sign only.
_REST = re.compile(r"((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
#: A comment's rest, which may be nothing, or end in an exclamation mark; any other declaration's rest.
_COMMENT, _DECLARATION = re.compile(r"-?>|(?s:.*?)--!?>"), re.compile(r"[^>]*+>")
#: Attributes that end in a value without quotes; a slash at its end belongs to it.
_UNQUOTED = re.compile(r"=\s*[^\s\"'>][^\s>]*$")
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: For each element name, the kinds of ENDS that it belongs to or bounds.
_KINDS = {tag: [kind for kind, (names, within) in ENDS.items() if tag in names | within] for names, within in ENDS.values() for tag in names | within}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Node:
    __slots__ = ("tag", "parent", "parts", "out", "score", "chars", "headed", "linked", "scope")

    def __init__(self, tag: str, parent: _Node | None, out: int) -> None:
        self.tag, self.parent, self.out = tag, parent, out
        self.parts: list = []  # texts and nodes in page order
        self.score, self.chars, self.headed, self.linked = 0.0, 0, 0, 0
        self.scope: _Node | None = self if tag in SCOPES or parent is None else parent.scope


def _marked(tag: str, attributes: str, by_words: bool) -> int:
    """0: seems part of the text; 1: marked as something else, unless an article stands in it; 2: something else."""
    if tag in NEVER:
        return 2
    if not attributes or tag in SPARED:
        return 0
    found = 0
    for m in _ATTR.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if name in ("class", "id", "role") and by_words:
            for part in value.split():
                words = _WORD.findall(_CAMEL.sub("-", part).lower())
                if part.lower() in UNSEEN or FIRM.intersection(words):
                    return 2
                if words and words[0] not in WITH and MARKS.intersection(words) and not (tag == "article" and words[0] not in MARKS):
                    found = 1
    return found


def _settled(root: _Node) -> None:
    """Marks of the first kind go from elements around an article or a main element; the others hold for all within."""
    around: set[int] = set()
    for node, leaving in _walk(root):
        if leaving and (node.tag in ("article", "main") and node.out != 2 or id(node) in around) and node.parent is not None:
            around.add(id(node.parent))
    for node, leaving in _walk(root):
        if not leaving:
            above = node.parent.out if node.parent is not None else False
            node.out = bool(above or node.out == 2 or (node.out == 1 and id(node) not in around))


def _tree(page: str, by_words: bool = True) -> tuple[_Node, bool]:
    """The root, and whether words in attributes mark anything."""
    worded = False
    root = top = _Node("#", None, 0)
    at, end = 0, len(page)
    open_tags: dict[str, list[_Node]] = {}
    # For each kind of element that a new one of it ends: those open, and the open elements that hold them, from outside in.
    open_ends: dict[str, list[_Node]] = {kind: [] for kind in ENDS}

    def enter(node: _Node) -> None:
        nonlocal top
        top = node
        open_tags.setdefault(node.tag, []).append(node)
        for kind in _KINDS.get(node.tag, ()):
            open_ends[kind].append(node)

    def pop_to(node: _Node) -> None:
        nonlocal top
        while top is not node:
            open_tags[top.tag].pop()
            for kind in _KINDS.get(top.tag, ()):
                open_ends[kind].pop()
            top = top.parent

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            top.parts.append(references.unescape(page[at:]))
            break
        if m.start() > at:
            top.parts.append(references.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            closed = (_COMMENT if m[0] == "<!--" else _DECLARATION).match(page, at)
            at = closed.end() if closed else end
            continue
        rest = _REST.match(page, at)
        if rest is None:
            break
        at = rest.end()
        tag, attributes = m[2].lower(), rest[1]
        if m[1]:
            if open_tags.get(tag):
                pop_to(open_tags[tag][-1].parent)
            elif tag in ("br", "p"):
                top.parts.append(" ")
            continue
        if tag in ENDS_P and top.scope.tag == "p":
            pop_to(top.scope.parent)
        if tag in ENDS:
            waiting = open_ends[tag]
            while waiting and waiting[-1].tag in ENDS[tag][0]:
                pop_to(waiting[-1].parent)
        node = _Node(tag, top, _marked(tag, attributes, by_words) if attributes or tag in NEVER else 0)
        worded = worded or node.out > 0 and tag not in NEVER
        top.parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in OPENS and not _UNQUOTED.search(attributes):
            continue
        if tag in RAW:
            closing = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = end if closing is None else page.find(">", closing.end()) + 1 or end
            continue
        enter(node)
    return root, worded


def _walk(root: _Node) -> Iterator[tuple[_Node, bool]]:
    """Each node twice: on entry, and on leaving (True)."""
    stack: list[tuple[_Node, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        yield node, leaving
        if not leaving:
            stack.append((node, True))
            stack.extend((x, False) for x in reversed(node.parts) if not isinstance(x, str))


def _scored(root: _Node) -> list[_Node]:
    """Points for all nodes; the nodes that got some."""
    found: dict[int, _Node] = {}
    for node, leaving in _walk(root):
        if node.out or not leaving:
            continue
        own = [x for x in node.parts if isinstance(x, str)]
        inline = [x for x in node.parts if not isinstance(x, str) and not x.out]
        chars = sum(len(x.strip()) for x in own)
        node.chars = chars + sum(x.chars for x in inline)
        node.headed = node.chars if node.tag in HEADINGS else sum(x.headed for x in inline)
        node.linked = node.chars if node.tag == "a" else sum(x.linked for x in inline)
        if node.parent is None or not (node.tag in PARAGRAPH or (node.tag in BLOCK and chars > 40)) or not node.chars:
            continue
        commas = sum(x.count(",") for x in own) + sum(y.count(",") for x in inline for y in x.parts if isinstance(y, str))
        points = (1 + commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)
        into = node.parent if node.tag in PARAGRAPH else node
        for share in (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12):
            if into is None or into.parent is None:
                break
            into.score += points * share
            found[id(into)] = into
            into = into.parent
    return list(found.values())


def _text(node: _Node, into: list[str]) -> None:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            into.append(x)
        elif x.out:
            if x.tag in BLOCK:
                into.append(" ")
        elif x.tag in BLOCK:
            stack.append(" ")
            stack.extend(reversed(x.parts))
            into.append(" ")
        else:
            stack.extend(reversed(x.parts))


def _density(node: _Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _worth(node: _Node) -> float:
    return node.score * (1 - _density(node)) * (BONUS if node.tag in ("article", "main") else 1)


def _within(node: _Node) -> bool:
    """Whether an article or main element is around node."""
    above = node.parent
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    return above is not None


def _kept(root: _Node) -> list[_Node]:
    """The best container and its siblings."""
    best = max(_scored(root), key=_worth, default=None)
    if best is None:
        return [root]
    least = SIBLING * _worth(best)
    while best.parent.parent is not None and best.parent.tag not in ("body", "html") and best.parent.chars - best.chars == best.parent.headed - best.headed:
        best = best.parent
    if best.tag in ("body", "html"):
        return [best]
    together = best.tag not in ("article", "main") and _within(best)

    def stays(x: _Node) -> bool:
        reads = x.tag in ("p", "blockquote", "pre") or x.tag in HEADINGS or together and x.tag in BLOCK
        return x is best or _worth(x) >= least > 0 or reads and _density(x) <= LINKS_MOST

    return [x for x in best.parent.parts if not isinstance(x, str) and not x.out and stays(x)]


def main_text(page: str | None) -> str:
    """The main text of one page; '' if it has none."""
    by_words = True
    while page:
        root, worded = _tree(page, by_words)
        _settled(root)
        into: list[str] = []
        for node in _kept(root):
            _text(node, into)
            into.append(" ")
        text = " ".join("".join(into).split())
        if text or not (worded and by_words):
            return text
        by_words = False
    return ""


def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(df: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """df with the main text of each page."""
    small_batches(df.sparkSession)
    return df.withColumn(into, F.pandas_udf(_main_texts, "string")(F.col(html)))
