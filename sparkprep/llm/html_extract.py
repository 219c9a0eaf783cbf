"""Main text of HTML pages from flat text blocks, classified by a decision tree.

A page is cut into text blocks at block-level tags. A block's features are word count and link density of itself and of two
neighbours on each side, and what the markup says: in an article, in a menu, footer, form or the like, in an element whose
class, id or role names boilerplate, in a heading. A decision tree, trained on the small labelled table that ``labelled``
makes of ``SAMPLES``, says which blocks are main text. Its first ``TEXT_DEPTH`` levels may ask for words and links alone;
markup serves below them, where these leave blocks mixed. Half of the table are pages bare of telling tags and names, so
pages without an article are told apart by their text. The driver trains the tree in a moment and sends it to the tasks.

Character references are decoded; white space inside a block becomes one space; blocks are joined by one newline. A null or
empty page, or one without main text, has the empty text. Every row returns, with equal rows or page_ids as they come. Unclosed
tags, comments and quotes end where the page ends, end tags without a start are skipped; pages of any length are read whole,
in time linear in their length. An empty table gives no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|title|select)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[!?/a-zA-Z][^>]*+(?:>|\Z)
    |(?P<text>[^<]++|<)""",
    re.S | re.I | re.X,
)
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var video wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
BOILERPLATE = frozenset("nav footer aside form dialog menu button fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that name boilerplate wherever they stand.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice gdpr newsletter subscribe "
    "subscription signup login comment comments reply replies respond disqus share sharing social related recommended recommendations popup modal overlay pagination pager copyright disclaimer contentinfo complementary".split()
)
#: Words that name boilerplate outside of an article and may belong to its text inside.
OUTSIDE_HINTS = frozenset("banner toolbar widget search alert skip".split())
#: The head of a page is boilerplate, that of an article is not.
PAGE_HEAD = frozenset(["header"])
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
#: Word count and link density of the block, of its neighbours and of theirs.
TEXT_FEATURES = [f"{kind}_{place}" for place in ("here", "before", "after", "second_before", "second_after") for kind in ("words", "links")]
FEATURES = [*TEXT_FEATURES, "in_main", "page_has_main", "in_boilerplate", "hinted", "heading"]
#: Levels of the tree that ask for TEXT_FEATURES alone, all levels, and the share of impurity that markup must take away.
TEXT_DEPTH, DEPTH = 3, 14
MARKUP_GAIN = 0.05


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    in_main: bool
    in_boilerplate: bool
    hinted: bool
    heading: bool


def hinted(attributes: str, main: bool) -> bool:
    for found in NAMED.findall(attributes):
        names = set(re.split(r"[^a-z0-9]+", "".join(found).lower()))
        if names & HINTS or not main and names & (PAGE_HEAD | OUTSIDE_HINTS):
            return True
    return bool(HIDDEN.search(attributes))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order."""
    out: list[Block] = []
    # Open elements with what holds inside them: (tag, in main, in boilerplate, hinted, heading); and how many of each tag.
    stack = [("", False, False, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        words = "".join(parts).split()
        if words:
            out.append(Block(" ".join(words), len(words), len("".join(linked).split()), *stack[-1][1:]))
        parts.clear()
        linked.clear()

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for token in TOKEN.finditer(page):
        text, tag = token["text"], token["tag"]
        if text is not None:
            text = references.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked.append(text)
            continue
        if tag is None:
            continue
        tag, attributes, main = tag.lower(), token["attributes"], stack[-1][1]
        if tag in INLINE:
            if tag == "a":
                links = 0 if token["end"] else 1
                linked.append(" ")
            elif tag == "br":
                parts.append(" ")
                linked.append(" ")
            # An inline element whose name tells boilerplate is a block; while it is open, so are those of its kind inside it.
            if tag in VOID or not (opened[tag] if token["end"] else opened[tag] or attributes and hinted(attributes, main)):
                continue
        flush()
        if token["end"]:
            if opened[tag]:
                while close() != tag:
                    pass
                links = 0
            continue
        if tag in VOID:
            continue
        if stack[-1][0] == "p" and tag not in INLINE or stack[-1][0] == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            if close() == "p" and tag == "li" and stack[-1][0] == "li":
                close()
        _, main, boilerplate, hint, heading = stack[-1]
        main = main or tag in MAIN
        stack.append((tag, main, boilerplate or tag in BOILERPLATE or tag in PAGE_HEAD and not main, hint or bool(attributes) and hinted(attributes, main), heading or tag in HEADINGS))
        opened[tag] += 1
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block; a neighbour that isn't there has no words."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], float)
    links = np.array([b.link_words for b in found]) / words

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(x))
        if by < 0:
            out[-by:] = x[:by]
        elif by:
            out[:-by] = x[by:]
        else:
            out = x
        return out

    flags = np.array([b[3:] for b in found], float)
    whole = np.full(len(found), flags[:, 0].max())
    return np.column_stack([*(moved(x, by) for by in (0, -1, 1, -2, 2) for x in (words, links)), flags[:, 0], whole, flags[:, 1:]])


class Node(NamedTuple):
    feature: int
    limit: float
    low: object
    high: object


def best_split(x: np.ndarray, y: np.ndarray, candidates: range) -> tuple[float, int, float]:
    """(Gini impurity, feature, limit) of the best split by one of the ``candidates``; the first of equally good ones counts."""
    best = (np.inf, 0, 0.0)
    for f in candidates:
        order = np.argsort(x[:, f], kind="stable")
        values, kept = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(values[1:] != values[:-1])  # the last row of the low side
        if len(at):
            n, a, b = at + 1.0, kept[at], kept[-1] - kept[at]
            impurity = a * (1 - a / n) + b * (1 - b / (len(y) - n))
            k = int(np.argmin(impurity))
            if impurity[k] < best[0] - 1e-9:
                best = (float(impurity[k]), f, float(values[at[k]] + values[at[k] + 1]) / 2)
    return best


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node | bool:
    """A decision tree by least Gini impurity. A leaf is whether blocks are kept.

    The first levels split by text. Below, markup comes first where it takes ``MARKUP_GAIN`` of the impurity away; its few
    flags carry over to other pages better than limits on words that happen to part the blocks left.
    """
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    text = range(len(TEXT_FEATURES))
    best = (np.inf, 0, 0.0)
    if depth <= DEPTH - TEXT_DEPTH:
        best = best_split(x, y, range(len(TEXT_FEATURES), x.shape[1]))
        if best[0] > (1 - MARKUP_GAIN) * len(y) * y.mean() * (1 - y.mean()):
            best = (np.inf, 0, 0.0)
    if best[0] == np.inf:
        best = best_split(x, y, text)
    if best[0] == np.inf:
        return bool(y.mean() >= 0.5)
    _, f, limit = best
    low = x[:, f] <= limit
    return Node(f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def keep(tree: Node | bool, row: list[float]) -> bool:
    while isinstance(tree, Node):
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree


#: Labelled pages: fragments with 1 for main text; {n} stands for n words. A fragment ends where a block ends. A fragment
#: marked 2 is boilerplate that only its markup tells from main text, one marked 3 main text that only its markup tells from
#: boilerplate: pages bare of markup are without them.
SAMPLES: list[list[tuple[int, str]]] = [
    [
        (0, "<nav><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul></nav><div class='ad'>{9}</div>"),
        (1, "<article><h1>{8}</h1><p>{60}</p><p>{2}</p><p>{35}</p><p>{9}</p><h2>{3}</h2><p>{120}</p><p>{1}</p></article>"),
        (0, "<footer>{12}</footer>"),
    ],
    [
        (2, "<header><h1>{3}</h1><p>{20}</p><a>{2}</a></header><div id='cookie-notice'><p>{40}</p></div>"),
        (1, "<main><h1>{6}</h1><p>{25} <a>{4}</a> {30}</p><p><a>{5}</a></p><ul><li>{7}</li><li>{3}</li><li><a>{4}</a> {2}</li></ul><table><tr><td>{2}</td><td>{5}</td></tr></table></main>"),
        (2, "<aside><h2>{3}</h2><p>{30}</p><ul><li><a>{5}</a></li><li><a>{6}</a></li></ul></aside><footer><p>{25}</p><p><a>{2}</a></p></footer>"),
    ],
    [
        (1, "<article><header><h1>{7}</h1></header><p>{80}</p><blockquote>{30}</blockquote>"),
        (2, "<form><p>{12}</p></form><div class='share-buttons'><a>{1}</a> <a>{1}</a></div><aside>{15}</aside>"),
        (1, "<p>{45}</p><p>{4}</p>"),
        (2, "<section id='comments'><h2>{2}</h2><div class='comment'><p>{40}</p></div><div class='comment'><p>{25}</p><a>{1}</a></div></section>"),
        (1, "</article>"),
        (0, "<div class='related'><h3>{2}</h3><a>{8}</a></div>"),
        (2, "<footer>{30}</footer>"),
    ],
    [
        (0, "<div class='menu'><a>{1}</a> <a>{1}</a> <a>{1}</a></div><div><a>{2}</a> | <a>{1}</a></div>"),
        (1, "<h1>{7}</h1><p>{55}</p><p>{70} <a>{3}</a> {5}</p><p>{16}</p><h2>{4}</h2><p>{38}</p><p>{21}</p>"),
        (0, "<div><a>{4}</a> <a>{3}</a> <a>{5}</a></div><div>{4} <a>{2}</a></div><div>{5}</div>"),
    ],
    [
        (0, "<div><a>{1}</a></div><div><a>{1}</a></div><div><a>{2}</a></div><div><a>{1}</a></div>"),
        (1, "<h2>{9}</h2><div>{90}</div><div>{44}</div><div>{13}</div><div>{61}</div>"),
        (0, "<p><a>{6}</a></p><p><a>{7}</a></p><p>{3}</p>"),
        (2, "<div class='newsletter-signup'><p>{22}</p></div><div role='contentinfo'>{18}</div>"),
    ],
    [
        (2, "<div class='header'><div>{4}</div></div><div class='sidebar'><p>{28}</p></div><dialog>{14}</dialog><div class='popup notice'>{33}</div>"),
        (1, "<article><p>{1}</p><p>{3}</p><p><a>{9}</a></p><div>{50}</div><pre>{20}</pre></article>"),
        (2, "<div class='advertisement'><p>{17}</p></div><div class='user-comments'><p>{65}</p></div><div><a>{3}</a></div><div>{6}</div><footer><div>{48}</div></footer>"),
    ],
    [
        (0, "<header><nav><a>{1}</a><a>{2}</a></nav></header>"),
        (1, "<p>{24}</p><p>{33}</p><p>{11}</p><p>{19}</p>"),
        (0, "<div>{3}</div><div><a>{2}</a></div>"),
    ],
    [
        (1, "<article><h1>{5}</h1><p>{70}</p><p>{30}</p>"),
        (2, "<div class='ad'>{20}</div><div class='promo'><p>{45}</p></div>"),
        (1, "<p>{52}</p><p>{66}</p>"),
        (2, "<aside><p>{38}</p></aside><div class='newsletter'><p>{14}</p><p>{60}</p></div>"),
        (1, "<p>{41}</p>"),
        (2, "<div class='reply'><p>{8}</p><p>{90}</p></div><div id='related'><h2>{4}</h2><p>{30}</p><ul><li><a>{5}</a></li></ul></div>"),
        (1, "</article>"),
    ],
    [
        (2, "<nav><p>{30}</p><ul><li>{9}</li><li>{12}</li></ul></nav><form><p>{35}</p><label>{3}</label></form><div class='cookie-banner'>{60}</div>"),
        (1, "<main><p>{44}</p><p>{12}</p><p>{9}</p>"),
        (3, "<p><a>{12}</a></p><p>{3} <a>{8}</a></p><ul><li><a>{1}</a></li><li><a>{2}</a></li><li>{1}</li></ul>"),
        (1, "<p>{64}</p></main>"),
        (2, "<footer><p>{55}</p><p>{10}</p><p>{3}</p></footer><div class='disclaimer'><p>{120}</p></div>"),
    ],
    [(2, "<div>{2}</div>"), (1, "<article><p>{2}</p><p>{1}</p><p>{1}</p></article>"), (2, "<div>{1}</div>")],
    [(1, "<main><p><a>{3}</a></p><p>{1}</p><p>{40}</p><p>{1}</p></main>"), (2, "<footer>{1}</footer><footer><a>{1}</a></footer>")],
    [(0, "<div><a>{4}</a></div>"), (1, "<article><h1>{1}</h1><p>{3}</p><ul><li>{1}</li><li>{2}</li><li>{1}</li></ul><p>{2}</p><p>{3}</p></article>"), (2, "<div>{3}</div><div>{2}</div>")],
    [(2, "<div><a>{6}</a></div><div>{2}</div>"), (1, "<article><p>{5}</p><p>{1}</p></article>"), (0, "<div><a>{1}</a></div>")],
    [(0, "<div><a>{1}</a></div>"), (1, "<h1>{4}</h1><p>{30}</p><p>{41}</p><p>{52}</p>"), (0, "<div><a>{1}</a> <a>{1}</a></div>")],
    [(0, "<div><a>{2}</a></div><div><a>{1}</a></div>"), (1, "<p>{80}</p><p>{12}</p><p>{64}</p>"), (0, "<div>{1}</div><div><a>{1}</a></div>")],
    [(0, "<p><a>{1}</a></p>"), (1, "<h2>{5}</h2><p>{22}</p><p>{47}</p>"), (0, "<p><a>{2}</a></p>")],
    [(0, "<nav><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{1}</a></li></ul></nav><div class='ad'>{12}</div>"), (1, "<article><h1>{10}</h1><p>{100}</p><p>{70}</p><p>{3}</p><p>{14}</p><p>{40}</p></article>"), (0, "<footer>{10}</footer>")],
    [(0, "<ul><li><a>{1}</a></li><li><a>{2}</a></li></ul>"), (1, "<article><h1>{6}</h1><p>{50}</p><p>{8}</p><p>{4}</p><p>{90}</p><p>{2}</p><p>{11}</p></article>"), (0, "<footer>{8}</footer>")],
    [
        (2, "<nav><p>{3}</p></nav><header><h1>{4}</h1></header>"),
        (1, "<article><h1>{6}</h1><p>{9}</p><div>{60}</div><p>{4}</p>"),
        (2, "<div class='ad'>{4}</div><aside>{8}</aside>"),
        (1, "<p>{3}</p><p>{12}</p><p>{4} <a>{6}</a></p>"),
        (2, "<div class='sponsored'><p>{50}</p></div>"),
        (1, "<p>{5}</p></article>"),
        (2, "<div class='comments'><p>{3}</p><p>{70}</p></div><footer>{4}</footer>"),
    ],
    [
        (0, "<nav><ul><li><a>{2}</a></li><li><a>{1}</a></li></ul></nav>"),
        (1, "<article><h2>{5}</h2><p>{40}</p>"),
        (3, "<p><a>{4}</a></p><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{1}</a></li></ul>"),
        (1, "<p>{80}</p>"),
        (2, "<div class='share'><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{1}</a></li></ul></div>"),
        (1, "<p>{20}</p>"),
        (3, "<p><a>{9}</a></p>"),
        (2, "<aside><ul><li><a>{3}</a></li><li><a>{2}</a></li><li><a>{4}</a></li></ul></aside>"),
        (1, "<p>{30}</p>"),
        (2, "<div class='related'><h3>{2}</h3><ul><li><a>{2}</a></li><li><a>{3}</a></li><li><a>{1}</a></li><li><a>{4}</a></li></ul></div>"),
        (1, "</article>"),
        (0, "<footer><a>{2}</a> <a>{1}</a></footer>"),
    ],
    [(1, "<p>{200}</p><p>{75}</p>")],
    [(1, "<p>{14}</p>")],
    [(1, "<h1>{5}</h1><p>{12}</p><p>{26}</p>"), (0, "<footer>{9}</footer>")],
]


#: Each sample stands in the table with its own word counts and with counts varied by so many draws.
VARIANTS = 30


def bare(page: str) -> str:
    """A page whose tags and names tell nothing of its parts; paragraphs, headings, lists and links stay."""
    page = re.sub(r"\s(?:class|id|role)='[^']*'", "", page)
    return re.sub(r"(</?)(?:article|main|header|footer|nav|aside|form|section|dialog)\b", r"\1div", page)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels of the blocks of ``SAMPLES``, as they are and bare, with varied word counts."""
    random, rows, labels = np.random.default_rng(42), [], []
    for page in SAMPLES:
        for variant in range(VARIANTS + 1):
            for stripped in (False, True):
                count = lambda m: max(1, round(int(m[1]) * (random.uniform(0.4, 2) if variant else 1)))
                # A bare page lacks what only markup tells; a varied one with markup lacks some boilerplate, so text ends pages too.
                there = lambda label: label == 1 or (label == 0 if stripped else label == 3 or not variant or random.random() < 0.6)
                parts = [(label % 2 == 1, re.sub(r"\{(\d+)\}", lambda m: "word " * count(m), text)) for label, text in page if there(label)]
                parts = [(label, bare(text) if stripped else text) for label, text in parts]
                upto = [len(blocks("".join(text for _, text in parts[: i + 1]))) for i in range(len(parts))]
                rows.append(features(blocks("".join(text for _, text in parts))))
                for (label, _), a, b in zip(parts, [0, *upto], upto):
                    labels += [label] * (b - a)
    return np.concatenate(rows), np.array(labels, bool)


@cache
def trained() -> Node | bool:
    return grow(*labelled())


def main_text(page: str, tree: Node | bool) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found).tolist()) if keep(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            texts = [main_text(x or "", tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
