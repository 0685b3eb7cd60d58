"""Operator 6: main text of web pages by tag-path ratios.

A page is read into text nodes with their root-to-leaf tag paths. For each path the
text length and the punctuation of its nodes are added up and divided by the number of nodes: paths
that carry running text have high ratios, those of menus low ones. The ratios are laid out in page order and
smoothed, and a path's own ratio is fused (geometric mean) with the mean smoothed ratio of its nodes. Paths over a
threshold (a share of the deviation) select content nodes, wherever they are; no path is weighed by what the page says of it. The result is the
text of the smallest element that holds nearly all selected text, with the selected blocks and the first-level headings outside
it. Where parts that the page marks as its article or main part hold half of the selected text at least, they are that element and
nothing outside them stays; marks that the ratios don't bear out are not followed. In the element, blocks without a selected node are rejected
if they are links only, or stand in a mere container (div, section ...) that has no selected text and no sentence: lists of links, share
boxes, notices. Headings, short paragraphs, list items, cells and loose text of the article stay.

Elements that never hold an article (nav, footer, form, script ...) are left out before anything is rated, and so are adverts and reader
comments (elements with a whole class or id such as `ad`, `sponsored`, `comments`). Elements named `sidebar`, `menu`, `notice` and the like are
rated like others, and go if they hold less than half of the selected text.

A null or empty html gives an empty text, and so do marked parts without any text. Broken markup is read as browsers do in the cases
that occur: open paragraphs and list items end where the next begins, the end of the page ends all, elements nested deeper than
DEPTH aren't nested further; where a quote is never closed, tags end at the next `>` from there on. The work is linear in the length
of a page, however long and broken it is. Rows repeat as they come; a null page_id or url stays null; an empty table
gives an empty table; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_columns

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAMES = re.compile(r"\S+")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?。…:;]")
_MARKS = re.compile(r"[.,;:!?。、，]")
# Fixed values of HTML: elements without an end tag, elements whose content is not markup, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("aside button datalist dialog embed footer form head input label menu nav noscript object option script select style svg template textarea title iframe canvas audio video".split())
SIGNS = frozenset("banner breadcrumb breadcrumbs consent cookie cookies footer masthead menu nav navbar navigation newsletter notice notices pagination popup related share sharing sidebar signup social subscribe toolbar widget".split())
FOREIGN = frozenset("ad ads advert advertisement adverts advertising comment comments disqus promo promoted replies reply sponsor sponsored".split())  # adverts and readers' comments
KEEP = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("address blockquote caption dd dt figcaption li p pre summary td th".split())  # blocks of an article, where others are containers
CLOSES_P = BLOCK - {"body", "html"}
DEPTH = 256


class Path:
    """A root-to-leaf tag path; there is one object for each, made by its parent."""

    __slots__ = ("tag", "parent", "below", "link", "heading", "first", "block", "marked")

    def __init__(self, tag: str, parent: Path | None, marked: bool):
        self.tag, self.parent, self.below = tag, parent, {}
        self.link = tag == "a" or bool(parent and parent.link)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.first = tag == "h1" or bool(parent and parent.first)
        self.block = tag if tag in BLOCK else parent.block if parent else ""  # the innermost block
        self.marked = marked or bool(parent and parent.marked)

    def step(self, tag: str, names: str, marked: bool) -> Path:
        key = tag, names, marked
        if key not in self.below:
            self.below[key] = Path(tag, self, marked)
        return self.below[key]


@dataclass(slots=True)
class Node:
    path: Path
    element: int
    text: str
    block: int
    left_out: bool


@dataclass(slots=True)
class Element:
    """Elements are numbered in page order, so those in one are the numbers up to its `last`."""

    parent: int
    tag: str
    sign: bool  # its class or id is in SIGNS
    last: int


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends, `>` in quotes aside; -1 if nowhere."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = page.find(m[0], m.end()) + 1
        if not at:
            break
    return -1


def text_nodes(page: str) -> tuple[list[Node], list[Element]]:
    """Text nodes in page order, character references decoded; and the elements (number 0 holds all)."""
    found: list[Node] = []
    elements = [Element(0, "", False, 0)]
    names: list[str] = []
    numbers, paths, bad = [0], [Path("", None, False)], [0]
    opened: Counter[str] = Counter()
    flat: Counter[str] = Counter()  # open elements that are too deep
    block = at = 0
    quotes = True

    def add(text: str) -> None:
        if text and not text.isspace():
            found.append(Node(paths[-1], numbers[-1], html.unescape(text), block, bad[-1] > 0))
        elif text and found:
            found.append(Node(paths[-1], numbers[-1], " ", block, bad[-1] > 0))

    def pop(k: int) -> None:
        nonlocal block
        if any(n in BLOCK for n in names[k:]):
            block += 1
        opened.subtract(names[k:])
        for e in numbers[k + 1 :]:
            elements[e].last = len(elements) - 1
        del names[k:], numbers[k + 1 :], paths[k + 1 :], bad[k + 1 :]

    while m := _OPEN.search(page, at):
        if m[0] == "<!--":
            add(page[at : m.start()])
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        end = _tag_end(page, m.end()) if quotes and m[0][1] not in "!?" else -1
        if end < 0:
            quotes = quotes and m[0][1] in "!?"
            end = page.find(">", m.end())
            if end < 0:
                break
        add(page[at : m.start()])
        at = end + 1
        if m[0][1] in "!?":
            continue
        name = _NAME.match(page, m.end() - 1)
        tag, rest = name[0].lower(), page[name.end() : end]
        if m[0][1] == "/":
            if flat[tag]:
                flat[tag] -= 1
            elif opened[tag]:
                pop(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag in CLOSES_P and opened["p"]:
            k = len(names) - 1 - names[::-1].index("p")
            if not any(n in BLOCK for n in names[k + 1 :]):
                pop(k)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(names) - 1, -1, -1):
                if names[k] == tag or {names[k], tag} <= {"dt", "dd"} or {names[k], tag} <= {"td", "th"}:
                    pop(k)
                    break
                if names[k] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            if tag == "br":
                add(" ") if found else None
            continue
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = closed.end() if closed else len(page)
            continue
        if rest.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if len(names) >= DEPTH:
            flat[tag] += 1
            continue
        attributes = {a[1].lower(): (a[2] or a[3] or a[4] or "").lower() for a in _ATTRIBUTE.finditer(rest)} if rest else {}
        named = attributes.get("class", "") + " " + attributes.get("id", "")
        role = attributes.get("role")
        foreign = tag not in KEEP and not FOREIGN.isdisjoint(_NAMES.findall(named))
        out = foreign or tag in NEVER or (tag == "header" and not paths[-1].marked) or (tag not in KEEP and role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"))
        sign = tag not in KEEP and not SIGNS.isdisjoint(_NAMES.findall(named))
        words = ".".join(sorted(set(_WORDS.findall(named)))) if tag in ("div", "section", "span") else ""
        elements.append(Element(numbers[-1], tag, sign, 0))
        numbers.append(len(elements) - 1)
        paths.append(paths[-1].step(tag, words, tag in ("article", "main") or role == "main"))
        bad.append(bad[-1] + out)
        names.append(tag)
        opened[tag] += 1
    add(page[at:])
    pop(0)
    elements[0].last = len(elements) - 1
    return found, elements


def path_ratios(nodes: list[Node]) -> dict[Path, float]:
    """Smoothed and fused ratio of text and punctuation for each tag path."""
    length: dict[Path, int] = {}
    marks: dict[Path, int] = {}
    number: dict[Path, int] = {}
    for n in nodes:
        if n.text != " ":
            length[n.path] = length.get(n.path, 0) + len(n.text)
            marks[n.path] = marks.get(n.path, 0) + len(_MARKS.findall(n.text))
            number[n.path] = number.get(n.path, 0) + 1
    own = {p: math.log1p(length[p] / number[p] * (1 + marks[p] / number[p])) for p in length}
    series = np.array([own[n.path] for n in nodes if n.text != " "])
    kernel = np.array([1.0, 4.0, 6.0, 4.0, 1.0])
    weight = np.convolve(np.ones(len(series)), kernel, "same")[: len(series)] if len(series) >= 5 else None
    smooth = np.convolve(series, kernel, "same") / weight if weight is not None else series
    total: dict[Path, float] = {}
    for n, v in zip((n for n in nodes if n.text != " "), smooth):
        total[n.path] = total.get(n.path, 0.0) + float(v)
    return {p: math.sqrt(own[p] * total[p] / number[p]) for p in own}


def _stays(block: list[Node], high: set[Path], inside: range, held: list[int]) -> bool:
    """Whether a block has a selected node; or is a heading, prose or loose text, not links only, in the article's element; or a first-level
    heading beside it. held: selected text by element."""
    rated = [n for n in block if n.text != " "]
    if not rated or any(n.path in high for n in rated):
        return bool(rated)
    if not any(n.element in inside for n in rated):
        return any(n.path.first for n in rated)
    if any(n.path.heading for n in rated):
        return True
    plain = [n for n in rated if not n.path.link]
    return any(n.path.block in PROSE or held[n.element] > 0 for n in plain) or bool(_SENTENCE.search("".join(n.text for n in plain)))


def main_text(page: str | None, share: float = 0.9, slack: float = 0.8) -> str:
    """Blocks of the article, parted by an empty line."""
    nodes, elements = text_nodes(page or "")
    marked = any(e.tag in ("article", "main") for e in elements) or any(n.path.marked for n in nodes)
    nodes = [n for n in nodes if not n.left_out]
    if not any(n.text != " " and (n.path.marked or not marked) for n in nodes):
        return ""
    ratios = path_ratios(nodes)
    values = np.array([ratios[n.path] for n in nodes if n.text != " "])
    limit = min(float(values.max()) * 0.8, float(values.mean()) + slack * float(values.std())) - 1e-9
    high = {p for p, r in ratios.items() if r >= limit}

    def selected(only: list[Node]) -> list[int]:
        held = [0] * len(elements)
        for n in only:
            if n.text != " " and n.path in high:
                held[n.element] += len(n.text)
        for k in range(len(elements) - 1, 0, -1):
            held[elements[k].parent] += held[k]
        return held

    held = selected(nodes)
    stays = [True] * len(elements)
    for k, e in enumerate(elements):
        stays[k] = stays[e.parent] and (not e.sign or 2 * held[k] > held[0])
    nodes = [n for n in nodes if stays[n.element]]
    in_marked = [n for n in nodes if n.path.marked]
    held, within = selected(nodes), selected(in_marked)
    if 2 * within[0] >= held[0] > 0 and within[0]:
        nodes, held = in_marked, within
        inside = range(len(elements))  # all that is left
    else:
        root = max((k for k, e in enumerate(elements) if k and held[k] >= share * held[0] and e.tag in KEEP | {"div", "section", "td", "center"}), default=0)
        inside = range(root, elements[root].last + 1)
    blocks: dict[int, list[Node]] = {}
    for n in nodes:
        blocks.setdefault(n.block, []).append(n)
    parts = (_SPACE.sub(" ", "".join(n.text for n in b)).strip() for b in blocks.values() if _stays(b, high, inside, held))
    return "\n\n".join(p for p in parts if p)


_EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(cols: dict) -> dict:
    texts = [main_text(h) for h in cols["html"]]
    return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page. One narrow stage without a shuffle."""
    return map_columns(pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"]), _extract, _EXTRACTED)
