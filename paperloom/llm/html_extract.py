"""Main-text extraction: a linear-chain conditional random field over the leaf
blocks of a page's DOM, decoded by Viterbi.

A page is cut into leaf blocks (runs of text between block-level tags). Each
block has features of its ancestors' tags and class words and of its text; the
chain has two labels, article and other. The field is trained by maximum
likelihood on labelled pages from labelled_pages.py: laid out by templates with
semantic and plain markup, with every kind of page furniture.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_memory, text_or_empty

FEATURES = 1 << 14

# Element kinds of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page. The first kind takes all up
#: to its end tag, or to the end of the page; of the second, what has no end tag
#: is only a tag. (A head needs no rule: all that may be in it goes by these.)
DROPPED = ("script", "style", "noscript", "template", "textarea", "iframe", "title")
DROPPED_WITH_END = ("select", "object", "svg", "math", "canvas", "audio", "video")
#: An open element of the key ends where one of the values starts.
P_ENDERS = BLOCK - frozenset("option optgroup legend caption body html tbody td tfoot th thead tr li dd dt".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl select body html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<drop>" + "|".join(DROPPED) + r")(?![\w:-])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=drop)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)|[^<]+|<",
    re.I | re.S,
)
_END_OF = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in DROPPED_WITH_END}
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


class Node:
    """An open element: what it adds to the names of its ancestors. value is a
    model's sum of weights of all names on the way to it."""

    __slots__ = ("tag", "parent", "new", "value")

    def __init__(self, tag: str, parent: Node | None, new: tuple[str, ...]):
        self.tag, self.parent, self.new, self.value = tag, parent, new, None

    def up(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


class Block:
    """A leaf block: its text, how much of it is linked, and its element."""

    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: int, node: Node | None):
        self.text, self.linked, self.node = text, linked, node


class _Open:
    """The open elements of a page. Where the last one of a tag and the last
    block lie is kept, so no tag looks through the others."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.names: Counter = Counter()
        self.all_names: list[tuple[str, ...]] = []

    def last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def push(self, tag: str, attrs: str) -> None:
        names = _names(_element(tag, attrs))
        node = Node(tag, self.nodes[-1] if self.nodes else None, tuple(n for n in names if not self.names[n]))
        self.names.update(names)
        self.at[tag].append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.all_names.append(names)

    def close(self, at: int) -> None:
        """Closes the elements from a place on."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.names.subtract(self.all_names.pop())

    def end(self, tag: str) -> None:
        """An end tag closes its last element, if no block is open within an
        element that is none; one without its element is passed over."""
        at = self.last((tag,))
        if at >= 0 and (tag in BLOCK or at > (self.blocks[-1] if self.blocks else -1)):
            self.close(at)

    def begin(self, tag: str) -> None:
        """What ends because a block starts."""
        if tag == "body" and self.at["head"]:  # a head may be left open
            self.close(self.at["head"][0])
        if tag in P_ENDERS and self.blocks and self.nodes[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        sibling = self.last(SIBLINGS.get(tag, ()))
        if sibling > self.last(SCOPES):
            self.close(sibling)


@lru_cache(65536)
def _element(tag: str, attrs: str) -> str:
    """tag and the words of class, id and role, as one key."""
    words = {w for m in _ATTR.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return " ".join([tag, *sorted(words)])


@lru_cache(65536)
def _names(key: str) -> tuple[str, ...]:
    tag, *words = key.split(" ")
    return (f"in:{tag}", *(f"word:{w}" for w in words))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in time in proportion to its length."""
    opened = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, linked, opened.nodes[-1] if opened.nodes else None))
            parts.clear()
        linked = 0

    at_char, endless = 0, set()
    while m := _TOKEN.match(page, at_char):
        at_char, tag = m.end(), m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if opened.at["a"]:
                    linked += len(piece)
            elif m["drop"] and m["drop"].lower() in BLOCK:
                flush()
            continue
        tag = tag.lower()
        if tag in _END_OF:
            if not m["end"] and not m["attrs"].endswith("/") and tag not in endless:
                if end := _END_OF[tag].search(page, at_char):
                    at_char = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK:
            if tag in BLOCK:
                flush()
            else:
                parts.append(" ") if tag == "br" else None
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            opened.end(tag)
            continue
        if tag in BLOCK:
            opened.begin(tag)
        opened.push(tag, m["attrs"])
    flush()
    return out


@lru_cache(1 << 16)
def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def path_features(node: Node | None) -> list[int]:
    if node is None:
        return []
    names = {n for above in node.up() for n in above.new}
    return sorted(map(_number, [*names, f"own:{node.tag}"]))


def text_features(block: Block) -> tuple[int, ...]:
    t, n = block.text, len(block.text)
    names = [f"length:{min(9, n.bit_length())}", f"links:{min(4, 4 * block.linked // max(1, n))}", f"end:{t[-1] if t[-1] in '.!?:' else 'a' if t[-1].isalnum() else 'x'}"]
    if "©" in t:
        names.append("copyright")
    if n > 40 and t.count(", ") * 60 > n:
        names.append("commas")
    return tuple(map(_number, names))


class Model:
    """weights of label 1 against 0 by feature; step[a, b] of label a before b."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.weights, self.step, self.start = weights, step, start

    def _value(self, node: Node | None) -> float:
        """The weights of all names on the way to an element; each is added once."""
        way = []
        while node is not None and node.value is None:
            way.append(node)
            node = node.parent
        value = node.value if node is not None else 0.0
        for node in reversed(way):
            value = node.value = value + sum(self.weights[_number(n)] for n in node.new)
        return value

    def unary(self, b: Block) -> float:
        own = self.weights[_number(f"own:{b.node.tag}")] if b.node is not None else 0.0
        return self._value(b.node) + own + sum(self.weights[i] for i in text_features(b))

    def viterbi(self, page: Sequence[Block]) -> list[int]:
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.start[0], self.start[1] + self.unary(page[0])
        back = []
        for block in page[1:]:
            to0, to1 = (a + s00, b + s10), (a + s01, b + s11)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0), max(to1) + self.unary(block)
        label, out = int(b > a), []
        for choice in reversed(back):
            out.append(label)
            label = choice[label]
        return [label, *out[::-1]]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.viterbi(found)) if y)


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], rounds: int = 200, l2: float = 0.005, rate: float = 0.1) -> Model:
    """Maximum likelihood with an l2 penalty by Adam; forward and backward run
    over all pages at once, padded to the longest."""
    pages = [p for p in pages if p[0]]
    most = max(len(b) for b, _ in pages)
    y = np.zeros((len(pages), most), int)
    live = np.zeros((len(pages), most), bool)
    flat, starts, where = [], [], []
    for i, (found, labels) in enumerate(pages):
        live[i, : len(found)], y[i, : len(found)] = True, labels
        for j, b in enumerate(found):
            starts.append(len(flat))
            flat += [*path_features(b.node), *text_features(b)]
            where.append((i, j))
    flat, starts, where = np.array(flat), np.array(starts), np.array(where)
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(flat)]))
    theta = np.zeros(FEATURES + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair_live = live[:, 1:]
    for t in range(1, rounds + 1):
        w, step, start = theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :]
        unary = np.zeros((len(pages), most, 2))
        unary[where[:, 0], where[:, 1], 1] = np.add.reduceat(w[flat], starts)
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = start + unary[:, 0]
        for j in range(1, most):
            alpha[:, j] = np.where(live[:, j, None], np.logaddexp(alpha[:, j - 1, :1] + step[0], alpha[:, j - 1, 1:] + step[1]) + unary[:, j], alpha[:, j - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        for j in range(most - 2, -1, -1):
            after = unary[:, j + 1] + beta[:, j + 1]
            beta[:, j] = np.where(live[:, j + 1, None], np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1]), 0)
        p = np.exp(alpha + beta - z)
        pair = np.exp(alpha[:, :-1, :, None] + step + (unary + beta)[:, 1:, None, :] - z[..., None]) * pair_live[..., None, None]
        g = np.zeros_like(theta)
        error = p[where[:, 0], where[:, 1], 1] - y[where[:, 0], where[:, 1]]
        np.add.at(g, flat, error[owner])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pair_live], y[:, 1:][pair_live]), 1)
        g[FEATURES : FEATURES + 4] = (pair.sum(axis=(0, 1)) - seen).ravel()
        g[FEATURES + 4 :] = p[:, 0].sum(axis=0) - np.bincount(y[:, 0], minlength=2)
        g = g / len(pages) + l2 * theta / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])


@lru_cache(1)
def default_model() -> Model:
    from .labelled_pages import labelled_pages

    return train(labelled_pages())


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """One row for each row of pages: id_col, url_col, text, n_chars.

    Null html counts as empty; a page without article blocks has empty text.
    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed. Cut-off pages are read as far as
    they go, and plain text without markup is one block. Repeated rows get
    equal rows; other columns are ignored, whatever their names; an empty table
    gives an empty result. A page is worked on by itself, in time and memory in
    proportion to its length, however deep its elements are nested.
    """
    bounded_memory(pages.sparkSession)
    rows = pages.select(id_col, url_col, text_or_empty(html_col).alias("html"))
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())  # 2**14 weights

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(sent.value.text)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = rows.select(id_col, url_col, F.pandas_udf(of, "string")("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
