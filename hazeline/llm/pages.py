"""Main text of web pages by a maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Every token has a weight learnt from labelled pages: the log odds of its
surroundings for words, so that words of running text score positive, and that of its name for tags, which is kept
negative.  One linear scan finds the contiguous region with the largest sum.  Inside it, elements that never are
article text (scripts, forms, menus, notices, comments) are left out, and the blocks that remain are joined.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import pieces, schema_with, sent, texts, thinned, with_columns

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|object)\b(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>?|[^<]++|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|[\s\"'/=<]")
NAMING = frozenset(("class", "id", "role", "aria-label"))
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
# Names from the HTML standard, and words that sites use in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav footer aside form button select option menu dialog head title script style noscript iframe svg canvas audio video object template textarea".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion "
    "disqus disclaimer footer footnav header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags toolbar topbar widget widgets".split())
#: Parts of a class that tell of a state of the page and not of what the element is, as in no-sidebar or comments-open.
STATE_WORDS = frozenset("no not has have with without open opened closed off on enabled disabled".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story text".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def named_words(attributes: str) -> tuple[set[str], bool]:
    """The words in an element's class, id, role and label, and whether it is hidden."""
    words: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        name = (m.group(1) or "").lower()
        hidden |= name == "hidden"
        if name in NAMING:
            for part in (m.group(2) or m.group(3) or m.group(4) or "").split():
                own = {w.lower() for w in NAME.findall(part)}
                if not own & STATE_WORDS:
                    words |= own
    return words, hidden


def kind_of(tag: str, attributes: str, inside_article: bool, trusting: bool = True) -> str:
    """What an element is by its name and attributes: side, main or plain.  The whole page is never a side, and without
    ``trusting`` no element is one for its attributes."""
    if tag in ("html", "body"):
        return "plain"
    if tag in NEVER or tag == "header" and not inside_article:
        return "side"
    if attributes:
        words, hidden = named_words(attributes)
        if trusting and (hidden or words & SIDE_WORDS and not (words & MAIN_WORDS and not words & {"comment", "comments", "sidebar"})):
            return "side"
        if words & MAIN_WORDS:
            return "main"
    return "main" if tag in ("article", "main") else "plain"


class Open:
    """The open elements.  Each knows what its surroundings come to, so nothing walks the whole stack."""

    def __init__(self, trusting: bool):
        self.trusting, self.stack, self.count = trusting, [], Counter()

    def push(self, tag: str, attributes: str) -> None:
        _, side, main, article, link, block = self.stack[-1] if self.stack else ("", "", False, False, False, "none")
        kind = kind_of(tag, attributes, article, self.trusting)
        if kind == "side" and not side:
            side = "inner" if main else "side"
        self.stack.append((tag, side, main or kind == "main", article or tag in ("article", "main"), link or tag == "a", block if tag in INLINE else tag))
        self.count[tag] += 1

    def cut(self, at: int) -> None:
        for tag, *_ in self.stack[at:]:
            self.count[tag] -= 1
        del self.stack[at:]

    def close(self, tag: str) -> None:
        """Ends the nearest open element of the name, and with a block all that is open in it."""
        if not self.count[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            other = self.stack[i][0]
            if other == tag:
                return self.cut(i)
            if tag in INLINE and other not in INLINE:
                return None

    def close_paragraph(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            other = self.stack[i][0]
            if other == "p":
                return self.cut(i)
            if other not in INLINE:
                return None

    def context(self) -> str:
        if not self.stack:
            return "none"
        _, side, main, _, link, block = self.stack[-1]
        return side or ("main" if main else "link" if link else block)


def tokens(page: str, trusting: bool = True) -> Iterator[tuple[str, str, str]]:
    """``(what, value, context)``: tags with their name, and text with what it lies in.

    The context is side inside a menu, footer, form and so on (inner if that lies in an article), main inside an article element, link inside an anchor,
    or the name of the nearest block.  Elements left open end with the element around them.
    """
    around = Open(trusting)
    now = "none"
    for m in TOKEN.finditer(page):
        raw = m.group()
        name = m.group(3)
        if name is None:
            if m.group(1) or raw.startswith(("<!", "<?")):
                continue
            yield "text", raw, now
            continue
        tag, closing = name.lower(), bool(m.group(2))
        if closing:
            around.close(tag)
        elif tag not in VOID and not m.group(4).rstrip().endswith("/"):
            if tag in CLOSES_P and around.count["p"]:
                around.close_paragraph()
            if around.stack and around.stack[-1][0] in SELF_CLOSING.get(tag, ()):
                around.cut(len(around.stack) - 1)
            around.push(tag, m.group(4))
        now = around.context()
        yield ("close" if closing else "open"), tag, now


FEW = 20


class Weights:
    """Log odds of contexts and tag names, with one smoothing count."""

    def __init__(self, words: Counter, tags: Counter):
        def odds(counts, name, base):
            good, bad = counts[name, True] + base[0], counts[name, False] + base[1]
            return float(np.log(good / (sum(v for (_, y), v in counts.items() if y) + 1)) - np.log(bad / (sum(v for (_, y), v in counts.items() if not y) + 1)))

        self.word = {n: float(np.clip(odds(words, n, (1, 1)), -3, 3)) for n in {n for n, _ in words}}
        # surroundings that labelled pages leave open or hold by definition
        for name, low, high in (("side", -3.0, -1.0), ("main", 1.0, 3.0), ("p", 0.5, 3.0), ("link", -3.0, -0.2), ("none", 0.2, 3.0)):
            self.word[name] = float(np.clip(self.word.get(name, 0.0), low, high))
        self.other = 0.2
        self.tag = {n: float(np.clip(odds(tags, n, (1, 1)), -3, -0.1)) for n in {n for n, _ in tags}}
        self.rare = -1.0


def region(weights: Weights, page: str) -> list[tuple[str, str, str]]:
    """The tokens with the largest sum of weights, by one scan; the first of equal ones.

    If elements named like menus, notices or comments hold all of a page's words but a few, the names say nothing, and only
    tag names tell.
    """
    seq = list(tokens(page))
    outside = sum(len(v.split()) for what, v, where in seq if what == "text" and where not in ("side", "inner"))
    if outside < FEW:
        other = list(tokens(page, trusting=False))
        if sum(len(v.split()) for what, v, where in other if what == "text" and where not in ("side", "inner")) >= 2 * FEW:
            seq = other
    best = total = 0.0
    start = first = last = 0
    for i, (what, value, where) in enumerate(seq):
        if where == "inner":
            continue  # left out anyway, so it neither adds nor ends a region
        if what == "text":
            total += len(value.split()) * weights.word.get(where, weights.other)
        else:
            total += weights.tag.get(value, weights.rare) if where != "main" else 0.5 * weights.tag.get(value, weights.rare) * (value not in INLINE)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return seq[first:last]


def main_text(weights: Weights, page: str) -> str:
    """Blocks of the best region, white space joined, two line feeds between them."""
    blocks, own = [], []
    for what, value, where in [*region(weights, page), ("open", "p", "none")]:
        if what == "text":
            if where not in ("side", "inner"):
                own.append(value)
        elif value == "br":
            own.append(" ")
        elif value not in INLINE:
            block = SPACE.sub(" ", html.unescape("".join(own))).strip()
            if block:
                blocks.append(block)
            own = []
    return "\n\n".join(blocks)


def counted(page: str) -> tuple[Counter, Counter] | None:
    """Word and tag counts of a labelled page by whether they belong to the article; None for pages without labels.

    A page labels itself if it has an article or main element: what lies in it, and in no side element, is article.
    """
    words, tags = Counter(), Counter()
    labelled = False
    for what, value, where in tokens(page):
        good = where == "main"
        labelled |= good
        if what == "text":
            n = len(value.split())
            if n:
                words[where, good] += n
                if good:
                    words["p", True] += n
        else:
            tags[value, good] += 1
    return (words, tags) if labelled else None


def train(pages: DataFrame, page: str = "html", most: int = 500) -> Weights:
    """Weights from the counts of about 1.5 times ``most`` pages, by hash order, that carry article marks.  Counts are made on
    the executors; only sums reach the driver, of names seen more than a few times, as rarer ones weigh next to nothing."""
    order = F.xxhash64(F.lit("pages"), page)
    some = thinned(pages.select(page).filter(F.col(page).isNotNull()), order, most, pages.count())

    def work(batches):
        total = [Counter(), Counter()]
        for batch in batches:
            for p in texts(batch.column(page)):
                for t, c in zip(total, counted(p) or ()):
                    t.update(c)
        rows = [(k, n, y, v) for k, t in zip(("word", "tag"), total) for (n, y), v in t.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "name", "good", "n"), r)) for r in rows],
                                         schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("good", pa.bool_()), ("n", pa.int64())]))

    sums = some.mapInArrow(work, "kind string, name string, good boolean, n bigint").groupBy("kind", "name", "good").agg(F.sum("n").alias("n"))
    words, tags = Counter(), Counter()
    for r in sums.filter("n >= 5").orderBy("kind", "name", "good").collect():
        (words if r.kind == "word" else tags)[r.name, r.good] = r.n
    return Weights(words, tags)


def extracted(df: DataFrame, weights: Weights, page: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``, the main text of the whole page; empty for null and empty pages and pages without a region that
    scores above zero.  Other columns and repeated rows stay; a column named like ``text`` is replaced."""
    held = sent(df.sparkSession, weights)

    def work(batches):
        own = held()
        for batch in (p for b in batches for p in pieces(b, page)):
            yield with_columns(batch, {text: pa.array([main_text(own, p) for p in texts(batch.column(page))], pa.string())})

    return df.mapInArrow(work, schema_with(df, f"`{text}` string"))
