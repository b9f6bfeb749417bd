"""Main-text extraction by two-pass block rules.

Pass one decides a block from its own figures: stop-word density, length, link density and the containers it stands
in. Pass two lets ambiguous blocks inherit the label of their nearest decided neighbours. A named article says where to
look, not what is text: the passes decide inside it as well.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_of

#: Function words of some languages; a share of them marks running prose.
STOP_WORDS = {
    "en": "the of and to a in is that for it on was as with be by at this are from or an have not they which but had his you were all there their one we has",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch",
    "fr": "de la le les et des en un une du est que dans qui par pour au sur il pas plus ne se ce sont avec ou son cette aux mais comme nous être elle à",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta",
}
_ALL_STOP_WORDS = frozenset(" ".join(STOP_WORDS.values()).split())

#: Limits of pass one. Shorter blocks than SHORT characters are ambiguous; stop-word density counts on pages whose
#: words are FITS stop words at least, for another language's words say nothing.
SHORT, LONG, PROSE, SPARSE, LINKED, FITS = 70, 200, 0.20, 0.08, 0.34, 0.10

#: Elements without text of their own. The first two end at their end tag alone, whatever comes before it.
_TO_THE_END = frozenset(("script", "style"))
_NO_TEXT = frozenset("script style noscript template svg math iframe object textarea select option button head title canvas audio video map".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
_BAD_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
#: Words in classes, ids and roles that name what isn't the article; ``*`` stands for any ending.
_BAD_WORDS = (
    "ad ads adbox adslot adv advert* adsense sponsor* promo* banner* nav navbar navi navigation topnav subnav menu menus menubar breadcrumb* sidebar* rail masthead footer* comment* disqus* "
    "respond replies cookie* consent* gdpr notice* notification* alert* popup* modal* overlay* newsletter* subscri* signup signin login share* sharing social* related* recommend* teaser* "
    "widget* search* pagination pager toolbar skip skiplink hidden complementary contentinfo copyright"
).split()
_BAD_NAME = re.compile(r"(?:^|[^a-z])(?:" + "|".join(w.replace("*", "[a-z]*") for w in _BAD_WORDS) + r")(?:$|[^a-z])")
_HEADER_NAME = re.compile(r"(?:^|[^a-z])header(?:$|[^a-z])")
_NOT_ARTICLE = re.compile(r"(?:^|[^a-z])(?:comments?|reply|ads?|advert|promo|related|sponsored|teaser)(?:$|[^a-z])")
_NOT_ARTICLE_CLASSES = {"comment", "comments", "ad", "ads", "advert", "promo", "sponsored", "teaser"}
_MAIN_NAME = re.compile(r"(?:^| )(?:(?:article|post|entry|story|main)[-_]?(?:body|content|text)|article|main)(?:$| )")
#: Names of a layout that has (or lacks) a side part, rather than of the part.
_LAYOUT = re.compile(r"(?:^|[^a-z])(?:has|with|no|without)[^a-z]|(?:sidebar|nav|navbar|menu|header|banner|masthead|footer|rail|widget)s?[^a-z]?(?:wrap|container|layout|page|content|main)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: To the end of a tag: only a quote that opens a value can hide a ``>``.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HEADING = re.compile("h[1-6]")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"""[.!?:;…。！？।؟]["'”’»)\]]*$""")


class Node:
    """A container: what its tag says, what its name says, and whether it stands in an article."""

    __slots__ = ("parent", "tag", "bad_tag", "bad_name", "inside", "names", "bad", "decided", "near")

    def __init__(self, parent: Node | None, tag: str, bad_tag: bool = False, bad_name: bool = False, inside: bool = False, names: str = ""):
        self.parent, self.tag, self.bad_tag, self.bad_name, self.inside, self.names = parent, tag, bad_tag, bad_name, inside, names
        self.bad, self.decided, self.near = False, [], None


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    own_bad: bool
    node: Node
    label: str = field(default="")  # good, bad, or short while undecided


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of every tag in one pass; comments and declarations have no name.

    An attribute value in quotes may have any length and hold anything. Where a tag would run to the end of the page
    for a quote that isn't closed, quotes mean nothing from there on.
    """
    at, quotes = 0, True
    while m := _START.search(page, at):
        if m[1]:
            end = page.find("-->", m.start() + 2)
            end = end + 3 if end >= 0 else len(page)
        else:
            rest = _REST.match(page, m.end()) if quotes and m[3] else None
            if rest:
                end = rest.end()
            else:
                quotes = quotes and not m[3]
                end = page.find(">", m.end()) + 1
                if not end:
                    return
        yield m.start(), end, bool(m[2]), (m[3] or "").lower(), page[m.end() : end - 1]
        at = end
        if m[3] and not m[2] and m[3].lower() in _TO_THE_END:
            close = re.compile(f"</{m[3]}(?=[\\s/>])", re.I).search(page, end)
            at = close.start() if close else len(page)
            yield end, at, False, "", ""


class Skips:
    """Where the elements without text end: at the end tag that belongs to the start tag. One without an end tag is a tag alone."""

    def __init__(self, page: str):
        self.page, self.by_name = page, {}

    def end(self, name: str, start: int) -> int | None:
        if name not in self.by_name:
            open_, pairs = [], {}
            for m in re.finditer(f"<(/?){name}(?=[\\s/>])", self.page, re.I):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    pairs[open_.pop()] = m.start()
            self.by_name[name] = pairs
        return self.by_name[name].get(start)


def _names(attrs: str) -> str:
    """Classes, id and role in lower case, camel case divided."""
    if "=" not in attrs:
        return ""
    return " ".join(_CAMEL.sub("-", m[1] or m[2] or m[3] or "").lower() for m in _NAMES.finditer(attrs))


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in order, and its containers, outer ones first."""
    nodes = [Node(None, "")]
    stack = [nodes[0]]
    found: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    own_bad = heading = in_link = False
    skips, until = Skips(page), 0

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                found.append(Block(text, linked, heading, own_bad, stack[-1]))
            parts.clear()
            links.clear()

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                links.append(text)

    at = 0
    for start, stop, closing, tag, attrs in tags(page):
        if start < until:  # within an element without text
            at = max(at, stop if stop > until else until)
            continue
        say(page[at:start])
        at = stop
        if tag in _NO_TEXT:
            if not closing and tag not in _TO_THE_END and not attrs.endswith("/") and (over := skips.end(tag, start)):
                until = at = over
            say(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            say(" ")
        elif tag in _BLOCKS:
            end()
            own_bad = heading = in_link = False
            if closing:
                if tag in _CONTAINERS:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == tag:
                            del stack[i:]
                            break
                continue
            inside, names = stack[-1].inside, _names(attrs)
            named = bool(_BAD_NAME.search(names)) or (not inside and bool(_HEADER_NAME.search(names)))
            if tag in _CONTAINERS:
                main = tag in ("article", "main")
                if main:
                    named = bool(_NOT_ARTICLE.search(names)) if inside else bool(_NOT_ARTICLE_CLASSES & set(names.split()))
                elif tag == "body":
                    named = False
                elif not named:
                    main = bool(_MAIN_NAME.search(names))
                nodes.append(Node(stack[-1], tag, tag in _BAD_TAGS and not (tag == "header" and inside), named, inside or (main and not named), names))
                stack.append(nodes[-1])
            else:
                own_bad, heading = named and tag != "html", bool(_HEADING.fullmatch(tag))
    say(page[at:])
    end()
    return found, nodes


def _stops(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in _ALL_STOP_WORDS for w in words), len(words)


def _first_pass(found: list[Block], nodes: list[Node], ignored: set[Node]) -> bool:
    """Labels blocks good, bad or short; whether the page names an article that isn't in a bad container."""
    article = False
    for n in nodes:
        n.bad = (n.parent.bad if n.parent else False) or n.bad_tag or (n.bad_name and n not in ignored)
        article = article or (n.inside and not n.bad)
    counts = [_stops(b.text) for b in found]
    here = [(s, w) for b, (s, w) in zip(found, counts, strict=True) if not (b.node.bad or b.own_bad)]
    fits = sum(s for s, _ in here) >= FITS * sum(w for _, w in here)
    for b, (stops, words) in zip(found, counts, strict=True):
        size, share = len(b.text), stops / max(1, words)
        if b.node.bad or b.own_bad or (article and not b.node.inside) or b.linked > LINKED * size:
            b.label = "bad"
        elif size < SHORT:
            b.label = "short"
        elif not fits:
            b.label = "good" if _SENTENCE.search(b.text) else "short"
        elif share >= PROSE or (size >= LONG and share >= SPARSE):
            b.label = "good"
        else:  # no prose by its words: a list, a caption, code; where it stands decides
            b.label = "short"
    return article


def _wrappers(found: list[Block], nodes: list[Node]) -> set[Node]:
    """Containers of bad names that hold the article, or are named like a layout and hold at least half of the prose."""
    size: dict[Node, int] = {}
    for b in found:
        if b.linked <= LINKED * len(b.text) and len(b.text) >= SHORT:
            size[b.node] = size.get(b.node, 0) + len(b.text)
    total, holds = sum(size.values()), {n for n in nodes if n.inside and not n.parent.inside}
    for n in reversed(nodes):  # inner ones first
        if n.parent:
            size[n.parent] = size.get(n.parent, 0) + size.get(n, 0)
            if n in holds:
                holds.add(n.parent)
    return {n for n in nodes if n.bad_name and (n in holds or (_LAYOUT.search(n.names) and 2 * size.get(n, 0) >= max(total, 1)))}


def label(found: list[Block], nodes: list[Node]) -> list[Block]:
    """Labels every block good or bad.

    An ambiguous block takes the label of the nearest decided block that stands directly in its container, or in the next
    container outwards that has one. Where there is none, of the decided blocks before and after it: theirs if they
    agree, the following one's for a heading; otherwise a whole sentence is text. Without any good block all ambiguous ones are.
    """
    article = _first_pass(found, nodes, set())
    if not any(b.label == "good" for b in found) and (ignored := _wrappers(found, nodes)):
        article = _first_pass(found, nodes, ignored)
    decided = [b.label for b in found]
    if "good" not in decided:
        for b in found:
            b.label = "good" if b.label == "short" else "bad"
        return found
    for i, b in enumerate(found):
        if b.label != "short" and not b.own_bad and b.linked <= LINKED * len(b.text):
            b.node.decided.append(i)
    for n in nodes:
        n.near = n if n.decided else n.parent.near if n.parent else None
    before, last = [], "bad"
    for b in found:
        before.append(last)
        last = b.label if b.label != "short" else last
    after, last = [], "bad"
    for b in reversed(found):
        after.append(last)
        last = b.label if b.label != "short" else last
    for i, (b, was, x, y) in enumerate(zip(found, decided, before, reversed(after), strict=True)):
        if was != "short":
            continue
        if b.node.near and (not article or b.node.near.inside):
            own = b.node.near.decided
            k = bisect(own, i)
            near = min(own[max(0, k - 1) : k + 1], key=lambda j: (abs(j - i), j < i))
            b.label = decided[near]
        elif article:
            b.label = "good"
        else:
            b.label = x if x == y else y if b.heading else "good" if _SENTENCE.search(b.text) else "bad"
    return found


def extract(page: str) -> str:
    return "\n\n".join(b.text for b in label(*blocks_of(page)) if b.label == "good")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(p.as_py()) for p in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    The blocks of the main text, in order, joined by two newlines; white space inside a block is one space and character
    references are decoded. Null or empty html, and a page without main text, give an empty text. Repeated rows are
    extracted each; other columns are ignored; an empty table gives an empty result. Rows never leave their partition.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    out = rows.mapInArrow(_extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
