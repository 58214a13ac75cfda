"""Main text of web pages by a linear-chain conditional random field.

A page is read into leaf blocks: the text between two block-level tags, with
the tags and class or id words of its ancestors. Each block has ancestor
features and text features; two labels (article or not) form a chain in page
order. The field is trained by penalised likelihood (forward-backward) on
TRAIN_PAGES labelled pages, a bound that is a parameter, and a page is decoded
by Viterbi. Scripts, styles, comments and other markup are never blocks.

Character references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one space.

Defined cases: null or empty html, and pages without article blocks, give an
empty text. Null page_ids and urls are passed along, one row out per row in.
Pages that are cut off or not well formed are read as far as they go: what may
not be in a head ends it, and an unread element without an end tag of its own
ends where the next block starts (but scripts and styles). Very long pages are
read whole, in one pass. Other columns are not read, whatever their names. No
rows in, no rows out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, texts
from tessera.llm.html_pages import labelled_pages

TRAIN_PAGES, EPOCHS, RATE, L2 = 500, 150, 0.15, 1e-3

#: How tags shape a page.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template head title svg iframe object select option textarea math canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend label li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = BLOCK - {"li", "td", "th", "tr", "dd", "dt", "tbody", "thead", "tfoot", "body", "html", "label", "button", "caption", "summary", "legend"}
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")


class _Tokens(HTMLParser):
    """Tags and text of a page in order; `closed` has the places of unread start tags that have an end tag of their own."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, str, list | None]] = []
        self.closed: set[int] = set()
        self._opened: dict[str, list[int]] = {}
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNREAD:
            self._opened.setdefault(tag, []).append(len(self.tokens))
        self.tokens.append(("start", tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tokens.append(("startend", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        if self._opened.get(tag):
            self.closed.add(self._opened[tag].pop())
        self.tokens.append(("end", tag, None))

    def handle_data(self, data: str) -> None:
        self.tokens.append(("data", data, None))


class _Reader:
    """Leaf blocks of one page: (text, ancestor features, share of its characters in links)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
        self.open: Counter[str] = Counter()  # tags in the stack
        self.unread: list[tuple[int, bool]] = []  # places of unread elements in the stack, and whether only an end tag ends them
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, frozenset[str], float]] = []

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.stack[-1][1], min(1.0, self.linked / len(text))))
            self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        self.links -= sum(tag == "a" for tag, _ in self.stack[at:])
        self.open.subtract(tag for tag, _ in self.stack[at:])
        while self.unread and self.unread[-1][0] >= at:
            self.unread.pop()
        del self.stack[at:]

    def _end_unread(self) -> None:
        """A block starts: end the unread elements around it that nothing else ends."""
        while self.unread and not self.unread[-1][1]:
            self._pop(self.unread[-1][0])

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        if self.stack[-1][0] == "head" and tag not in HEAD:
            self._pop(len(self.stack) - 1)
        if self.unread and tag in BLOCK and tag not in VOID:
            self._end_unread()
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK or tag in UNREAD:
            self.end_block()
        if tag in VOID:
            return
        closes = CLOSES.get(tag) or ({"p"} if tag in _ENDS_P else ())
        if any(self.open[x] for x in closes):
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at][0] in closes:
                    self._pop(at)
                    break
                if self.stack[at][0] in BLOCK and self.stack[at][0] != "p":
                    break
        own = {f"in:{tag}"} if tag in BLOCK else set()
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                own |= {f"name:{x.lower()}" for x in _NAME.findall(v)}
        above = frozenset(f for f in self.stack[-1][1] if f[:5] != "leaf:") if tag in BLOCK else self.stack[-1][1]
        if tag in UNREAD:
            self.unread.append((len(self.stack), closed and tag != "head"))
        self.stack.append((tag, above | own | ({f"leaf:{tag}"} if tag in BLOCK else set()) if own else above))
        self.links += tag == "a"
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCK:
            self.end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in UNREAD:
            self.end_block()
        if self.open[tag]:  # an end tag without its start ends nothing, and isn't searched for
            self._pop(next(at for at in range(len(self.stack) - 1, 0, -1) if self.stack[at][0] == tag))

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and not data.isspace():
            self._pop(len(self.stack) - 1)
        if not self.unread:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str) -> list[tuple[str, frozenset[str], float]]:
    page, reader = _Tokens(html), _Reader()
    for at, (kind, what, attrs) in enumerate(page.tokens):
        if kind == "data":
            reader.handle_data(what)
        elif kind == "start":
            reader.handle_starttag(what, attrs, at in page.closed)
        elif kind == "end":
            reader.handle_endtag(what)
        else:
            reader.handle_startendtag(what, attrs)
    reader.end_block()
    return reader.blocks


def text_features(text: str, linked: float, at: int, n: int) -> list[str]:
    """Features of a block's own text and its place."""
    words = text.count(" ") + 1
    found = ["bias", f"words:{min(6, words.bit_length())}", f"linked:{int(linked * 3)}", f"end:{'mark' if text[-1] in '.!?' else 'none'}"]
    if "©" in text or "copyright" in text[:200].lower():
        found.append("copyright")
    if at == 0:
        found.append("first")
    if at == n - 1:
        found.append("last")
    return found


class Field:
    """A chain of two labels: block weights for label 1 over label 0, start and step weights."""

    def __init__(self, names: dict[str, int]) -> None:
        self.names = names
        self.w = np.zeros(len(names))
        self.start = np.zeros(2)
        self.step = np.zeros((2, 2))
        self._above: dict[frozenset, float] = {}

    def scores(self, blocks: list) -> list[float]:
        """Weight of label 1 of each block."""
        out, n = [], len(blocks)
        for k, (text, above, linked) in enumerate(blocks):
            if above not in self._above:
                if len(self._above) > 50_000:
                    self._above.clear()
                self._above[above] = sum(self.w[self.names[f]] for f in above if f in self.names)
            out.append(self._above[above] + sum(self.w[self.names[f]] for f in text_features(text, linked, k, n) if f in self.names))
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels of a chain, by Viterbi."""
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = self.start[0], self.start[1]
        back = []
        for k, s in enumerate(scores):
            if k:
                from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 > b + t11 else 1)
                a, b = max(a + t00, b + t10), max(a + t01, b + t11)
                back.append((from0, from1))
            b += s
        label = int(b > a)
        out = [label] if scores else []
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def gradient(field: Field, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean gradient of the log-likelihood of pages by w, start and step: what is seen less what the field expects, by forward-backward."""
    p, length, _ = x.shape
    pair = mask[:, 1:] * mask[:, :-1]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    s = np.zeros((p, length, 2))
    s[:, :, 1] = x @ field.w.astype(np.float32)
    ahead, behind = np.zeros((p, length, 2)), np.zeros((p, length, 2))
    ahead[:, 0] = field.start + s[:, 0]
    for k in range(1, length):
        ahead[:, k] = np.where(mask[:, k, None] > 0, lse(ahead[:, k - 1, :, None] + field.step, 1) + s[:, k], ahead[:, k - 1])
    for k in range(length - 2, -1, -1):
        behind[:, k] = np.where(mask[:, k + 1, None] > 0, lse(field.step + (s[:, k + 1] + behind[:, k + 1])[:, None, :], 2), 0)
    z = lse(ahead[:, -1], 1)
    one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None]) * mask
    gap = y * mask - one
    both = np.exp(ahead[:, :-1, :, None] + field.step + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
    seen_step = np.array([[(((y[:, :-1] == a) & (y[:, 1:] == b)) * pair).sum() for b in (0, 1)] for a in (0, 1)])
    start = np.array([(y[:, 0] == a).sum() for a in (0, 1)]) - np.array([p - one[:, 0].sum(), one[:, 0].sum()])
    return np.concatenate([np.einsum("plf,pl->f", x, gap, optimize=True), start, (seen_step - both.sum((0, 1))).ravel()]) / p


def train(pages: list[tuple[list, list[int]]], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> Field:
    """Fit a field to pages of (blocks, labels) by gradient ascent on the penalised log-likelihood."""
    pages = [p for p in pages if p[0]]
    features = [[[*above, *text_features(t, ln, k, len(blocks))] for k, (t, above, ln) in enumerate(blocks)] for blocks, _ in pages]
    seen: dict[str, int] = {}
    for page in features:
        for f in {f for block in page for f in block}:
            seen[f] = seen.get(f, 0) + 1
    names = {f: k for k, f in enumerate(sorted(f for f, c in seen.items() if c >= 3))}
    field = Field(names)
    p, length = len(pages), max(len(b) for b, _ in pages)
    x, y, mask = np.zeros((p, length, len(names)), np.float32), np.zeros((p, length), int), np.zeros((p, length))
    for i, (page, (_, labels)) in enumerate(zip(features, pages)):
        for k, (block, label) in enumerate(zip(page, labels)):
            x[i, k, [names[f] for f in block if f in names]] = 1
            y[i, k], mask[i, k] = label, 1
    moment = [np.zeros(len(names) + 6), np.zeros(len(names) + 6)]
    for epoch in range(1, epochs + 1):
        grad = gradient(field, x, y, mask)
        theta = np.concatenate([field.w, field.start, field.step.ravel()])
        grad -= l2 * theta
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad**2
        theta += rate * (moment[0] / (1 - 0.9**epoch)) / (np.sqrt(moment[1] / (1 - 0.99**epoch)) + 1e-8)
        field.w, field.start, field.step = theta[: len(names)], theta[len(names) : len(names) + 2], theta[len(names) + 2 :].reshape(2, 2)
    return field


def labelled_blocks(html: str) -> tuple[list, list[int]]:
    """Blocks and labels of a training page, whose blocks start with [[0]] or [[1]]."""
    blocks, labels = [], []
    for text, above, linked in leaf_blocks(html):
        labels.append(int(text[2]))
        blocks.append((text[5:] or "x", above, linked))
    return blocks, labels


@lru_cache(maxsize=2)
def default_field(n_pages: int = TRAIN_PAGES) -> Field:
    """The field trained on the labelled pages of html_pages."""
    return train([labelled_blocks(p) for p in labelled_pages(n_pages)])


def main_text(html: str, field: Field) -> str:
    blocks = leaf_blocks(html)
    return " ".join(b[0] for b, label in zip(blocks, field.decode(field.scores(blocks))) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    field = field or default_field()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [main_text(h, field) for h in texts(b.column(2))]
            yield batch("page_id url text n_chars", b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64()))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(go, "page_id long, url string, text string, n_chars long")
