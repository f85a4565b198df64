"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut at block tags into flat runs of text. A block has its words and the share
of them in links, the same of two neighbours on each side, how much plain text these
hold, where it stands, and what kind of element it is in. Tags and names that pages use
for what is around their text count by how little of the page's text their element
holds: a form around a whole page, or a column that is called "with-sidebar", says
nothing. A decision tree tells which blocks are main text. It is grown from the small
labelled pages below, by the usual Gini splits.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "words", "links", "words_before", "links_before", "words_two_before", "links_two_before",
    "words_after", "links_after", "words_two_after", "links_two_after", "plain_around",
    "position", "article", "framed", "named", "heading",
)

# The labelled table: a page a line, its blocks in order. + is main text; then what the
# block is in: a article, h heading, f an element for a page's frame (F one around it
# all), n an element named so (N one around it all); then words, and after / the percent
# of them in links.
LABELLED = """
-f1/100 -f1/100 -f1/100 -f1/100 -n11 +ah9 +a9 +a40 +a25 +a3 +a60 +a12 -f12
-f1/100 -f1/100 -f1/100 -n12 +ah2 +a2 -f9
-f1/100 -f1/100 -n20 +ah1 +a1 +a6 -f16
-f1/100 -f1/100 -n9 +ah10 +a10 +a30 +a2 +a1 -f7
-f2/100 -f1/100 -n14 +ah4 +a160 -f12
-f1/100 -f1/100 -n4 +ah6 +a6 -f3
-f1/100 -n8 +ah7 +a40 +a2 +a48 +a7 -f12
-f1/100 -n9 +ah5 +a123 +a1 +a9 -f11
-f1/100 -f1/100 -n9 +ah5 +a15 +a43 +a4 +a9 -f9
-f1/100 -n10 +ah11 +a138 +a7 +a79 +a3 +a2 -f16
-f1/100 -f1/100 -f1/100 -n7 +ah3 +a3 +a1 +a30 +a90 +a60 +a25 +a70 +a44 +a1 +a2 +a4 -f6
-f1/100 +ah3 +a2 -af1 -f7
-f1/100 +ah6 +a40 -af20 +a50 -af8 -f7
-1/100 +ah4 +a70 -af60 -af30/10 -f7
-f1/100 -n13 +ah6 +a19 +a34 -f10
-f1/100 -n9 +ah8 +a27 +a36 -f15
-f1/100 -n8 +ah5 +a11 +a37 -f7
-f1/100 -n7 +ah5 +a25 +a35 -f8
-1/100 -1/100 -2/100 -4 +h8 +45 +60 +6 +38 +70 -2/100 -3/100 -7
-1/100 -2/100 -1/100 -9 -3/100 +h7 +80 +22/10 +5 +50 +44 -2/100 -11 -1/100 -1/100
-1/100 -1/100 -5 +h5 +120 +3 +90 +35/20 -1/100 -6 -2/100
-4 -1/100 -1/100 -1/100 +h9 +30 +28 +41 +33 -1/100 -1/100 -1/100 -12 -1/100
-2 -1/100 -2/100 -3 -1/100 +25 +60 +4 +55 +31 -3/100 -2/100 -9 -2/100
-f1/100 -f2/100 +Nh6 +N60 +N45 +N30 +N52 -f10
-f1/100 -n6 +Nh8 +N70 +N12 +N44 +N2 +N61 -f8
-n1/100 -n2/100 +Nh4 +N64 +N50 -n9 -n1/100
-1/100 -1/100 +h5 +50 +70 +40 +35 -n3 -n40 -n30 -1/100
-f1/100 +ah8 +a70 +a55 +a40 -nh2 -n2 -n35 -n2 -n60 -n1/100 -f8
-1/100 -1/100 +h8 +70 +55 +40 +90 -nh2 -n2 -n35 -n2 -n60 -n45 -n1/100 -8
-f1/100 +ah3 +a20 -nh1 -n2 -n40 -n25 -f5
+ah7 +a50 -an25 +a60 -an1/100 -an1/100 +a45 -an2 -an12/100 -an9/100 -f7
-Ff1/100 -Ff1/100 +Fh6 +F60 +F40 +F30 +F20 -Ff5 -Ff2/100
-f3 -f2 -f1 +h6 +50 +44 +38 -f20 -f4
-14/10 -1/100 -1/100 +h6 +66 +40 +52 -1/100 -8
-f30 -f25 +ah6 +a40 +a33 -f130 -f40
-f1/100 -n9 -f4
-1/100 -2/100 -1/100 -3 -1/100 -1/100
-n10 -n1/100 -f2
-n12/100 -f6
-5 +60 +60
-5 +60 +50 -3
-4 +h6 +60 +30 -6
-3 +45 +70 +4 +52 +33 -4
+h5 +60 +5 +70 +3 +44
+18
+90
+h4 +30
+h6 +22 +35 +4
+ah5 +a40 +a3 +a4 +a2 +a30 +a1/100 +a28
+ah5 +a20 +a1/100 +a2/100 +a4/100 +a30 -f9
-f1/100 +ah4 +a50 +a12/90 +a6/50 +a120/2 +a3 -f6
"""

# Fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object",
       "select", "canvas", "audio", "video", "title", "head", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr", "param"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd",
         "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
         "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend",
         "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "hgroup", "search"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Names by which pages mark what is not their text.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo",
         "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice",
         "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
         "signup", "login", "share", "sharing", "social", "sidebar", "widget", "widgets", "related",
         "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "reply",
         "replies", "respond", "discussion", "nav", "navbar", "navigation", "menu", "breadcrumb",
         "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "toolbar", "skip",
         "copyright", "legal", "search", "form", "aside", "tags", "navigationbar", "complementary",
         "contentinfo"}
HEADER_NAMES = {"header", "banner", "masthead"}

TAG = re.compile(
    r"<!--(?:.*?--!?>|>|->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
    re.I,
)
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is named as page frame, and whether as a page header."""
    named = header = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            named = named or key == "hidden"
        elif key == "style":
            named = named or bool(HIDDEN.search(value))
        elif key in ("class", "id", "role"):
            words = {w.lower() for w in NAME.findall(value)}
            header = header or bool(words & HEADER_NAMES)
            named = named or bool(words & NAMES - HEADER_NAMES)
    return named, header


@dataclass
class Block:
    """A flat run of text and the elements it stands in."""

    words: int
    links: float
    article: bool
    heading: bool
    frame: int
    name: int


@dataclass
class Elements:
    """Elements that may be a page's frame, each with the nearest one around it and its plain words."""

    around: list[int] = field(default_factory=list)
    plain: list[float] = field(default_factory=list)

    def open(self, around: int) -> int:
        self.around.append(around)
        self.plain.append(0.0)
        return len(self.plain) - 1

    def weights(self, total: float) -> list[float]:
        """How little of a page's plain words each holds; the last is that of no element."""
        for x in range(len(self.plain) - 1, -1, -1):
            if self.around[x] >= 0:
                self.plain[self.around[x]] += self.plain[x]
        return [1 - p / max(total, 1) for p in self.plain] + [0.0]


def features(blocks: list[Block], frames: Elements, names: Elements) -> list[list[float]]:
    """FEATURES of every block of a page."""
    plain = [b.words * (1 - b.links) for b in blocks]
    for b, words in zip(blocks, plain):
        for kind, at in ((frames, b.frame), (names, b.name)):
            if at >= 0:
                kind.plain[at] += words
    framed, named = frames.weights(sum(plain)), names.weights(sum(plain))
    any_article = any(b.article for b in blocks)
    out = []
    for k, b in enumerate(blocks):
        row = [float(b.words), b.links]
        around = 0.0
        for at in (k - 1, k - 2, k + 1, k + 2):
            inside = 0 <= at < len(blocks)
            row += [float(blocks[at].words), blocks[at].links] if inside else [0.0, 0.0]
            around += plain[at] if inside else 0.0
        row += [around, k / len(blocks), float(b.article) - float(any_article and not b.article)]
        out.append([*row, framed[b.frame], named[b.name], float(b.heading)])
    return out


def blocks_of(page: str) -> list[tuple[str, list[float]]]:
    """Flat text blocks of a page in order, with their features."""
    stack: list[tuple[str, bool, int, int]] = []
    on_stack: Counter = Counter()
    found: list[str] = []
    blocks: list[Block] = []
    frames, names = Elements(), Elements()
    text: list[str] = []
    linked = 0
    in_link = False
    article = heading = 0
    frame = name = -1

    def close() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            n = joined.count(" ") + 1
            found.append(joined)
            blocks.append(Block(n, min(1.0, linked / n), article > 0, heading > 0, frame, name))
        text.clear()
        linked = 0

    def leave(tag: str) -> None:
        """End the innermost open element of a tag, and all inside it."""
        nonlocal article, heading, frame, name
        while True:
            inner, is_article, frame, name = stack.pop()
            on_stack[inner] -= 1
            article -= is_article
            heading -= inner in HEADINGS
            if inner == tag:
                return

    at = 0
    while True:
        m = TAG.search(page, at)
        piece = html.unescape(page[at : m.start() if m else len(page)])
        if piece:
            text.append(piece)
            linked += len(piece.split()) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>|(?=<body\b)" if tag == "head"
                                 else rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br" or (tag not in BLOCK and tag in VOID):
            text.append(" ")
            continue
        is_block = tag in BLOCK
        if is_block:
            close()
            in_link = in_link and not closing
        if closing:
            if on_stack[tag]:
                leave(tag)
            continue
        if tag in VOID or (not is_block and not attributes):
            continue
        is_named, is_header = _marks(tag, attributes) if attributes else (False, False)
        if tag in ("html", "body", "main", "article"):
            is_named = is_header = False
        is_frame = tag in FRAME or ((tag == "header" or is_header) and not article)
        if not is_block and not is_named:
            continue
        if (tag == "p" or tag == "li" or tag in HEADINGS) and on_stack[tag]:
            # These end an open one of their kind.
            for entry in reversed(stack):
                if entry[0] == tag:
                    leave(tag)
                    break
                if entry[0] in BLOCK:
                    break
        is_article = tag in ("article", "main")
        stack.append((tag, is_article, frame, name))
        on_stack[tag] += 1
        frame = frames.open(frame) if is_frame else frame
        name = names.open(name) if is_named else name
        article += is_article
        heading += tag in HEADINGS
    close()
    return list(zip(found, features(blocks, frames, names)))


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows, labels = [], []
    for line in LABELLED.strip().splitlines():
        blocks, frames, names, last = [], Elements(), Elements(), ""
        whole = {k: e.open(-1) if k in line else -1 for k, e in (("F", frames), ("N", names))}
        open_ = {"f": -1, "n": -1}
        for token in line.split():
            label, kinds, words, links = re.fullmatch(r"([+-])([a-zFN]*)(\d+)(?:/(\d+))?", token).groups()
            for kind, outer, elements in (("f", "F", frames), ("n", "N", names)):
                if kind in kinds and kind not in last:
                    open_[kind] = elements.open(whole[outer] if outer in kinds else -1)
            inside = lambda kind, outer: (
                open_[kind] if kind in kinds else whole[outer] if outer in kinds else -1
            )
            share = int(links or 0) / 100
            blocks.append(Block(int(words), share, "a" in kinds, "h" in kinds, inside("f", "F"), inside("n", "N")))
            labels.append(int(label == "+"))
            last = kinds
        rows += features(blocks, frames, names)
    return np.array(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, least: int = 2) -> tuple:
    """A decision tree as nested (feature, limit, below, above); leaves are (share,)."""
    share = float(y.mean())
    best, chosen = share * (1 - share) * len(y) - 1e-9, None
    if 0 < share < 1 and len(y) >= 2 * least:
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for limit in (values[1:] + values[:-1]) / 2:
                low = x[:, k] < limit
                n = int(low.sum())
                if min(n, len(y) - n) < least:
                    continue
                a, b = y[low].mean(), y[~low].mean()
                left = a * (1 - a) * n + b * (1 - b) * (len(y) - n)
                if left < best:
                    best, chosen = left, (k, float(limit))
    if chosen is None:
        return (share,)
    k, limit = chosen
    low = x[:, k] < limit
    return (k, limit, grow(x[low], y[low], least), grow(x[~low], y[~low], least))


def is_text(tree: tuple, x: list[float]) -> bool:
    while len(tree) > 1:
        k, limit, below, above = tree
        tree = below if x[k] < limit else above
    return tree[0] > 0.5


def main_text(page: str, tree: tuple) -> str:
    return "\n\n".join(t for t, x in blocks_of(page) if is_text(tree, x))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, map-only.

    The whole page is read. Null or empty pages, and pages without main text,
    give an empty text. Repeated rows and null ids are rows like any other;
    other columns are ignored.
    """
    tree = grow(*labelled_blocks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, type=pa.string()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
