"""Main text of web pages from flat blocks and a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link
density, those of its two neighbours, its own form (heading, list item, end of a
sentence), the elements that it stands in, and one feature for what classes, ids
and roles around it say. A name made of nothing but words of places counts wherever
it stands; one that has other words beside them, or stands beside a name of main text,
counts only on an element that holds half of the page's unlinked words at most, and a
form around more than that is a frame. What follows a heading of comments is comments,
up to the end of its element or the next heading of its rank. A decision tree trained
on a small labelled table tells main text from the rest; the blocks that it keeps are
joined in page order by an empty line.

The labelled table is of two parts: pages labelled by hand (``labelled``), and
small pages made by a rule (``labelled_pages``) in three styles, of semantic
elements, of named divisions and of bare divisions. Its size is a parameter, and
the tree is the same on every run and machine.

Defined results: a null or empty page has an empty text; unclosed elements end
with the element around them or the page; a comment, script or style that is not
closed reaches to the end of the page; a hidden element is left out with what it
holds, and one that is never closed hides nothing; a class that names a state
(``comments-enabled``, ``with-sidebar``) says nothing of its content; a page of any
length is read in linear time; repeated rows give repeated results; an empty table
gives an empty result; ``main_texts`` carries the columns it is asked to carry,
whatever others there are.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwarden.llm.labelled import PAGES, labelled
from inkwarden.llm.text import read

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
#: Every attribute with its value, so that no name is looked for inside another or inside a value.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*(?:=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>]+))?")
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is no text, read up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements left out with all they hold.
DROPPED = frozenset("head noscript template svg math canvas object audio video select button datalist dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr link meta input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that blocks stand in; others only part blocks.
CONTAINERS = frozenset("article main nav header footer aside form section div ul ol dl table tbody thead tfoot tr figure details fieldset blockquote body".split())
#: What an element, role or name word says of all that it holds.
PLACES = {
    "main": "article main story",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs header masthead topbar branding logo banner footer colophon copyright contentinfo",
    "side": "aside sidebar complementary related recommended recommendations widget widgets popular trending share sharing social newsletter subscribe subscription ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted notice notices cookie cookies consent gdpr alert popup modal overlay paywall dialog disclaimer",
    "comment": "comment comments commentlist disqus reply replies respond discussion",
    "form": "form login signin signup register search",
    "hint": "content post entry body text",
}
#: Places that hold no main text, and those that do.
BAD, GOOD = frozenset({"nav", "side", "comment", "form"}), frozenset({"main", "hint"})
PLACE_OF = {word: place for place, names in PLACES.items() for word in names.split()}
#: Words of a class that tell of a state of the page, not of what the element holds.
STATES = frozenset("with without has have no not is enabled disabled open opened closed allowed active inactive on off count layout".split())
FEATURES = ("words", "link", "prev_words", "prev_link", "next_words", "next_link", "heading", "item", "sentence", "element", "named")


#: How often a page labelled by hand counts next to one made by rule.
BY_HAND = 1


#: Words of a name that say nothing of what an element holds, beside a word that does.
STRUCTURE = frozenset("list lists wrapper wrap box section container area block item items inner outer left right top bottom bar site page col row panel group unit slot zone region module holder primary secondary global local sub link links button buttons icon icons title count meta thread single".split())
#: A heading that opens readers' comments, with nothing beside it but their number and the like.
COMMENTS_HEADING = re.compile(r"\W*(?:(?:\d+|no|all|the|a|your|our|reader|readers|user|visitor|leave|post|add|write|join|view|show|discussion|and|from|to|s|deine?|ihre?|alle|keine|les|vos|des|laisser|un|los|tus|de|deja|dejar|un)\W+)*(?:comments?|replies|reply|responses|discussion|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas)(?:\W+(?:\d+|section|so|far|on|this|article|post))*\W*", re.I)


@dataclass
class Block:
    text: str
    words: int
    link: float
    inside: int  # its container, -1 for none
    names: tuple[frozenset[str], frozenset[str]]  # what its own class, id and role say, surely and maybe
    tag: str
    containers: list[Container]  # all of the page


@dataclass
class Container:
    """An element with the blocks and containers inside it, as ranges."""

    tag: str
    parent: int
    element: str  # what the element says of its content, or nothing
    names: tuple[frozenset[str], frozenset[str]]
    blocks: list[int]
    last: int = -1  # the last container inside


NO_NAMES: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())


def _places(tag: str, attributes: str) -> tuple[tuple[frozenset[str], frozenset[str]], bool]:
    """What the attributes of a start tag say of its content, surely and maybe, and whether it is hidden.

    A token says surely what it says with nothing but words of places and structure;
    beside other words, or beside a token that speaks of main text, only maybe.
    """
    sure: set[str] = set()
    maybe: set[str] = set()
    hidden = False
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif name in ("class", "id", "role"):
                for token in value.split():
                    words = [w.lower() for w in WORDS_OF_NAME.findall(token)]
                    if STATES.isdisjoint(words):
                        found = {PLACE_OF[w] for w in words if w in PLACE_OF}
                        plain = all(w in PLACE_OF or w in STRUCTURE for w in words) and found.isdisjoint(GOOD)
                        (sure if plain else maybe).update(found)
    if not sure.isdisjoint(BAD) and not maybe.isdisjoint(GOOD):
        maybe, sure = maybe | sure, set()
    return (frozenset(sure), frozenset(maybe)), hidden


def _closings(page: str, tag: str) -> dict[int, int]:
    """For each start tag of an element, by where it ends, where its end tag ends."""
    found, open_ = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}\b[^>]*>", page, re.I):
        if not m[1]:
            open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; its containers are in the order of their start tags."""
    page = page or ""
    out: list[Block] = []
    held: list[Container] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[int] = []  # containers that are open
    open_ = Counter[str]()  # their tags
    leaf, leaf_names = "", NO_NAMES
    closings: dict[str, dict[int, int]] = {}  # of elements that were hidden somewhere
    endless: set[str] = set()  # elements without another end tag
    anchors, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(html.unescape(t).split()) for t, a in pieces if a)
                out.append(Block(text, words, min(1.0, linked / words), stack[-1] if stack else -1, leaf_names, leaf, held))
            pieces = []

    def close() -> None:
        c = held[stack.pop()]
        open_[c.tag] -= 1
        c.blocks.append(len(out))
        c.last = len(held)

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            pieces.append((page[at:], anchors > 0))
            break
        if m.start() > at:
            pieces.append((page[at : m.start()], anchors > 0))
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if not closing and (tag in RAW or tag in DROPPED):
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            if tag in DROPPED and end is None:
                continue  # never closed: the text behind it is kept
            at = end.end() if end else size
            if tag not in INLINE and tag != "button":
                flush()
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append((" ", anchors > 0))
            continue
        flush()
        anchors = 0
        leaf, leaf_names = "", NO_NAMES
        if closing:
            while open_[tag]:
                done = held[stack[-1]].tag == tag
                close()
                if done:
                    break
            continue
        names, hidden = _places(tag, m[3])
        if hidden and tag not in VOID:
            if tag not in closings:
                closings[tag] = _closings(page, tag)
            at = closings[tag].get(m.end(), at)
            continue
        if tag in CONTAINERS:
            held.append(Container(tag, stack[-1] if stack else -1, PLACE_OF.get(tag, ""), names, [len(out)]))
            stack.append(len(held) - 1)
            open_[tag] += 1
        elif tag not in VOID:
            leaf, leaf_names = tag, names
    flush()
    while stack:
        close()
    return out


def _known(names: tuple[frozenset[str], frozenset[str]], most: bool, whole: bool) -> frozenset[str]:
    """What a name says where the element holds most of the page's unlinked words, and where it holds its title or article as well."""
    sure, maybe = names
    return (sure - BAD if whole else sure) | (maybe - BAD if most else maybe)


def places(found: list[Block], held: list[Container]) -> list[tuple[frozenset[str], frozenset[str]]]:
    """What elements and what names say of each block. The share of the page's words in an element outweighs a doubtful name."""
    free = np.cumsum([0.0, *(b.words * (1 - b.link) for b in found)])
    titles = np.cumsum([0, *(b.tag == "h1" for b in found)])
    mains = np.cumsum([0, *(c.tag in ("article", "main") for c in held)])
    none: frozenset[str] = frozenset()
    said: list[tuple[frozenset[str], frozenset[str]]] = []
    for k, c in enumerate(held):
        elements, names = said[c.parent] if c.parent >= 0 else (none, none)
        begin, end = c.blocks
        most = free[end] - free[begin] > free[-1] / 2
        whole = bool(most and (titles[end] > titles[begin] or mains[c.last] > mains[k]))
        own = frozenset({c.element}) - {""}
        if c.tag in ("article", "main"):  # wraps or forgets to close what stands before an article
            elements, names = elements - {"nav", "form"}, names - {"nav", "form"}
        elif c.tag == "header" and "main" in elements | names or c.tag == "form" and most:  # a form around a whole page
            own = none
        said.append((elements | own, names | _known(c.names, bool(most), whole)))
    out = []
    for k, b in enumerate(found):
        elements, names = said[b.inside] if b.inside >= 0 else (none, none)
        out.append((elements, names | _known(b.names, bool(free[k + 1] - free[k] > free[-1] / 2), False)))
    return out


def under_comments(found: list[Block], held: list[Container]) -> list[bool]:
    """Blocks behind a heading of comments, up to the end of its container or the next heading of its rank."""
    out, end, rank = [False] * len(found), 0, ""
    for k, b in enumerate(found):
        heading = b.tag[:1] == "h" and b.tag[1:].isdigit()
        if (heading or b.words <= 3) and COMMENTS_HEADING.fullmatch(b.text):
            end, rank = held[b.inside].blocks[1] if b.inside >= 0 else len(found), b.tag if heading else "h"
        elif heading and rank and (rank == "h" or b.tag <= rank):
            end = min(end, k)
        out[k] = k < end
    return out


def _sign(said: frozenset[str], *good: str) -> int:
    """-1 inside anything that is no main text, else 1 inside main text, else 0."""
    return -1 if said & BAD else int(not said.isdisjoint(good))


def matrix(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block of a page."""
    held = found[0].containers if found else []
    out = np.zeros((len(found), len(FEATURES)))
    for i, (b, (elements, names), comment) in enumerate(zip(found, places(found, held), under_comments(found, held), strict=True)):
        out[i, 0], out[i, 1] = b.words, b.link
        out[i, 6:9] = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit(), b.tag in ("li", "dt", "dd"), b.text[-1] in ".!?…\"'»”)"
        out[i, 9:] = _sign(elements, "main"), -1 if comment else _sign(names, "main", "hint")
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
    return out


# ---------------------------------------------------------------- the tree


@dataclass
class Node:
    share: float  # of main text
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit(x: np.ndarray, y: np.ndarray, depth: int = 9, leaf: int = 4) -> Node:
    """A Gini decision tree. Of equal splits the first feature and the lowest threshold win."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * leaf or node.share in (0.0, 1.0):
        return node
    best = node.share * (1 - node.share) * len(y) - 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        k = np.arange(leaf, len(y) - leaf + 1)
        k = k[v[k - 1] < v[k]] if len(k) and k[-1] < len(y) else k[:-1][v[k[:-1] - 1] < v[k[:-1]]] if len(k) else k
        if len(k):
            a, b = c[k - 1], c[-1] - c[k - 1]
            cost = a * (1 - a / k) + b * (1 - b / (len(y) - k))
            i = int(np.argmin(cost))
            if cost[i] < best:
                best, node.feature, node.at = float(cost[i]), f, float((v[k[i] - 1] + v[k[i]]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.at
        node.low, node.high = fit(x[low], y[low], depth - 1, leaf), fit(x[~low], y[~low], depth - 1, leaf)
    return node


def judge(node: Node, row) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.at else node.high
    return node.share > 0.5


def labelled_pages(n: int = 240, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Small pages with a label for each of their blocks, made by rule."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("aeioutnrsldmpchgb") for _ in range(rng.randint(2, 9))) for _ in range(k))
    link = lambda k: f'<a href="/x">{words(k)}{rng.choice(["", "", "", ".", ",", "!"])}</a>'
    pages = []
    for i in range(n):
        style = ("semantic", "named", "bare")[i % 3]
        body: list[str] = []
        labels: list[bool] = []

        def part(element: str, name: str, items: list[tuple[str, str, bool]], style=style, body=body, labels=labels) -> None:
            """One part of the page; items: (element, content, main text)."""
            tag = element if style == "semantic" else "div"
            mark = f' class="{name}"' if style == "named" or element == "div" and style != "bare" else ""
            body.append(f"<{tag}{mark}>" + "".join(f"<{t}>{c}</{t.split()[0]}>" for t, c, _ in items) + f"</{tag}>")
            labels.extend(m for _, _, m in items)

        def menu(k: int) -> list[tuple[str, str, bool]]:
            return [("li", link(rng.randint(1, 3)), False) for _ in range(k)]

        bare = style == "bare"
        if rng.random() < 0.5:
            part("header", rng.choice(["header", "masthead"]), [("p", link(rng.randint(1, 4)) if bare or rng.random() < 0.5 else words(rng.randint(1, 30)), False)])
        if rng.random() < 0.8:
            part("nav", rng.choice(["nav", "menu", "breadcrumbs"]), menu(rng.randint(2, 8)) if bare or rng.random() < 0.8 else [("li", words(rng.randint(1, 4)), False) for _ in range(4)])
        if not bare and rng.random() < 0.6:
            part("div", rng.choice(["ad", "notice", "cookie-notice", "promo"]), [("p", words(rng.randint(4, 40)) + ".", False)])
        article: list[tuple[str, str, bool]] = [("h1", words(rng.randint(1, 12)) + rng.choice(["", "", "."]), True)]
        for _ in range(rng.randint(1, 9)):
            k = rng.choice([rng.randint(1, 6), rng.randint(10, 40), rng.randint(40, 150)])
            text = words(k)
            if rng.random() < 0.2:
                text = f"{text} {link(2)} {words(3)}"
            elif not bare and rng.random() < 0.1:
                text = link(rng.randint(1, 8))
            article.append((rng.choice(["p", "p", "p", "h2", "li", "blockquote"]), text + rng.choice([".", ".", ".", ""]), True))
            if not bare and rng.random() < 0.15:
                article.append((rng.choice(['div class="ad"', 'aside class="related"', 'div class="comment"', "form", 'div class="newsletter notice"', "nav", 'section class="comments"']), link(rng.randint(1, 8)) if rng.random() < 0.4 else words(rng.randint(1, 40)) + ".", False))
        part("article", rng.choice(["article", "story", "post-content", "entry"]), article)
        if not bare and rng.random() < 0.5:
            part("aside", rng.choice(["sidebar", "related", "widget"]), [("h3", words(2), False), *menu(rng.randint(1, 5)), ("p", words(rng.randint(5, 60)) + ".", False)])
        if not bare and rng.random() < 0.5:
            part("form", rng.choice(["search", "login", "newsletter"]), [("p", words(rng.randint(1, 12)), False)])
        if not bare and rng.random() < 0.5:
            # comments have no element of their own
            k = rng.randint(1, 4)
            inside = "".join(f"<p>{words(rng.randint(3, 50))}.</p>" for _ in range(k))
            body.append(f'<section class="{rng.choice(["comments", "comment-list", "replies"])}">{inside}</section>')
            labels.extend([False] * k)
        if rng.random() < 0.6:
            part("footer", rng.choice(["footer", "copyright"]), [("p", f"&copy; {words(2)} &middot; {link(2)} {link(2)}" if bare else f"&copy; {words(rng.randint(2, 40))}.", False)])
        pages.append(("<html><body>" + "".join(body) + "</body></html>", labels))
    return pages


@lru_cache(maxsize=1)
def trained() -> Node:
    x, y = [], []
    for page, labels in [*labelled_pages(), *(labelled(p) for p in PAGES for _ in range(BY_HAND))]:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("a labelled page does not match its labels")
        x.append(matrix(found))
        y.append(np.array(labels, float))
    return fit(np.concatenate(x), np.concatenate(y))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, matrix(found).tolist(), strict=True) if judge(tree, row)) if found else ""


def main_texts(pages: DataFrame, columns: list[str], source: str = "html", tree: Node | None = None) -> DataFrame:
    """``columns``, the main text of each page and its length in code points."""
    tree = tree or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(source)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*columns, "text", "n_chars"])

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return pages.select(*dict.fromkeys([*columns, source])).mapInArrow(run, f"{kept}, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"), ["page_id", "url"])
