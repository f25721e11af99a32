"""Text paints among the instructions of a page.

Where a text is painted follows from the instructions before it: matrices are
multiplied, saved and restored. That fold is sequential, so pages are sorted
into partitions and read in one pass that keeps one page's state: a stack, two
matrices and the paints of the open group. Which paints go is told in the same
pass, for which the page's regions and spans are kept: joins would deal paints
and spans five times more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import distrust_unions

# Instructions that paint text, those of them that move to a line of their own, and the rendering modes that clip.
SHOWS, IMPLICIT, LEAST_CLIP = ("Tj", "TJ", "'", '"'), ("'", '"'), 4
#: Instructions that matter.
KNOWN = ("q", "Q", "cm", "BT", "ET", "Tm", "Td", "TD", "T*", "Tr", *SHOWS)
#: How far a span's origin may lie from its paint.
NEAR = 0.8
_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
PAINTS = "doc long, page long, seq long, grp long, x double, y double, explicit boolean, clip boolean"


def times(m: Sequence[float], n: Sequence[float]) -> tuple[float, ...]:
    """The map that does m first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


class _Page:
    def __init__(self):
        self.ctm, self.stack, self.text, self.line = _ONE, [], None, None
        self.group, self.clip, self.n = None, False, 0

    def step(self, seq: int, op: str, args: Sequence[float]) -> list[tuple]:
        """The paints of a group, once it is complete."""
        if op == "q":
            self.stack.append(self.ctm)
        elif op == "Q":
            self.ctm = self.stack.pop() if self.stack else _ONE
        elif op == "cm":
            self.ctm = times(args, self.ctm)
        elif op == "BT":
            self.group, self.clip, self.text, self.line = [], False, _ONE, _ONE
        elif op == "ET":
            done, self.group = self.group or [], None
            self.n += 1
            return [(seq, self.n, *place, self.clip) for seq, *place in done]
        elif self.group is None:
            pass
        elif op == "Tm":
            self.text = self.line = tuple(args)
        elif op in ("Td", "TD"):
            self.text = self.line = times((1.0, 0.0, 0.0, 1.0, args[0], args[1]), self.line)
        elif op == "T*":
            self.text = None
        elif op == "Tr":
            self.clip |= args[0] >= LEAST_CLIP
        elif op in SHOWS:
            explicit = self.text is not None and op not in IMPLICIT
            x, y = times(self.text, self.ctm)[4:] if explicit else (None, None)
            self.group.append((seq, x, y, explicit))
            self.text = None  # the next paint has to say where it is
        return []


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, page = None, _Page()
    for batch in batches:
        out = []
        for doc, at, seq, op, args in zip(batch["doc"], batch["page"], batch["seq"], batch["op"], batch["args"]):
            if (doc, at) != now:
                now, page = (doc, at), _Page()
            out += [(doc, at, *p) for p in page.step(seq, op, [] if args is None else list(args))]
        yield pd.DataFrame(out, columns=["doc", "page", "seq", "grp", "x", "y", "explicit", "clip"])


def text_paints(instructions: DataFrame) -> DataFrame:
    """instructions: (doc, page, seq, op, args array<double>), seq their order
    on a page. (doc, page, seq, grp, x, y, explicit, clip) for each text paint
    of a closed group: where it starts, whether its instructions say so, and
    whether its group clips. Only instructions that matter travel."""
    rows = instructions.filter(F.col("op").isin(*KNOWN)).select(F.col("doc").cast("long"), F.col("page").cast("long"), F.col("seq").cast("long"), "op", "args")
    return rows.repartition("doc", "page").sortWithinPartitions("doc", "page", "seq").mapInPandas(_folded, PAINTS)


# Kinds of a page's rows. Instructions follow, by their place in KNOWN.
HEIGHT, REGION, SPAN, FIRST = 0, 1, 2, 3


def _le(a: float, b: float) -> bool:
    """As in SQL, where NaN is above all numbers."""
    return a <= b or b != b


def _lt(a: float, b: float) -> bool:
    return a < b or (b != b and a == a)


def _inside(s: Sequence[float], r: Sequence[float]) -> bool:
    return _le(r[0], s[0]) and _le(r[1], s[1]) and _le(s[2], r[2]) and _le(s[3], r[3])


def _meets(s: Sequence[float], r: Sequence[float]) -> bool:
    return _lt(s[0], r[2]) and _lt(r[0], s[2]) and _lt(s[1], r[3]) and _lt(r[1], s[3])


class _Places:
    """Points by cells of NEAR: what is that near lies in the same or a neighbouring one."""

    def __init__(self):
        self.cells: dict[int, list[tuple[float, float]]] = {}

    def add(self, x: float, y: float) -> None:
        if math.isfinite(x):
            self.cells.setdefault(math.floor(x / NEAR), []).append((x, y))

    def near(self, x: float, y: float) -> bool:
        if not self.cells or not math.isfinite(x):
            return False
        at = math.floor(x / NEAR)
        return any(abs(x - a) < NEAR and abs(y - b) < NEAR for k in (at - 1, at, at + 1) for a, b in self.cells.get(k, ()))


class _Removal:
    """A page's heights, regions and spans, and then its instructions."""

    def __init__(self):
        self.heights, self.regions, self.spans = set(), [], []
        self.page, self.origins, self.gone = _Page(), None, _Places()

    def told(self, kind: int, args: tuple[float, ...]) -> None:
        if kind == HEIGHT:
            self.heights.add(args[0])
        elif kind == REGION:
            self.regions.append(args[:4])
        else:
            self.spans.append(args)

    def step(self, seq: int, op: str, args: tuple[float, ...]) -> list[int]:
        """The paints of a group that go, once it is complete."""
        group = self.page.step(seq, op, args)
        if not group or not self.heights or any(clip or not explicit for *_, explicit, clip in group):
            return []
        if self.origins is None:
            self.origins = _Places()
            for ox, oy, *box in self.spans:
                if any(_inside(box, r) for r in self.regions):
                    self.origins.add(ox, oy)
        places = dict.fromkeys((n, x, h - y) for n, _, x, y, _, _ in group for h in self.heights)
        if not all(self.origins.near(x, y) for _, x, y in places):
            return []
        for _, x, y in places:
            self.gone.add(x, y)
        return [n for n, _, _ in places]

    def left(self) -> int:
        """Spans that meet a region, and stay."""
        return sum(any(_meets(box, r) for r in self.regions) and not self.gone.near(ox, oy) for ox, oy, *box in self.spans)


def _pages(instructions: DataFrame, spans: DataFrame, regions: DataFrame, pages: DataFrame, declined: bool) -> DataFrame:
    """(doc, page, seq) of removed paints, or (doc, page, n_left). All that is
    known of a page is dealt by page once, and its instructions come last; the
    fold keeps the page's heights, regions and spans."""
    c = F.col
    distrust_unions(instructions.sparkSession)

    def rows(df: DataFrame, kind: Column, seq: Column, values: Sequence[Column]) -> DataFrame:
        values = [*values, *[F.lit(None)] * (6 - len(values))]
        known = df.filter(c("doc").isNotNull() & c("page").isNotNull())
        return known.select(c("doc").cast("long"), c("page").cast("long"), kind.cast("int").alias("kind"), seq.cast("long").alias("seq"), *[v.cast("double").alias(f"a{i}") for i, v in enumerate(values)])

    box, none = ["x0", "y0", "x1", "y1"], F.lit(0)
    whole = lambda df: df.filter(" AND ".join(f"{x} IS NOT NULL" for x in box))
    ops = rows(instructions.filter(c("op").isin(*KNOWN)), F.array_position(F.array(*[F.lit(op) for op in KNOWN]), c("op")) + (FIRST - 1), c("seq"), [F.get("args", i) for i in range(6)])
    told = rows(pages, F.lit(HEIGHT), none, [c("height")]).unionByName(rows(whole(regions), F.lit(REGION), none, [c(x) for x in box])).unionByName(rows(whole(spans), F.lit(SPAN), none, [c(x) for x in ("ox", "oy", *box)]))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, page, names = None, None, ["doc", "page", "n_left" if declined else "seq"]
        ends = lambda: [(*now, n)] if declined and now and (n := page.left()) else []
        for batch in batches:
            out = []
            for doc, at, kind, seq, *args in zip(*[batch[x].tolist() for x in ("doc", "page", "kind", "seq", *[f"a{i}" for i in range(6)])]):
                if (doc, at) != now:
                    out += ends()
                    now, page = (doc, at), _Removal()
                if kind < FIRST:
                    page.told(kind, args)
                    continue
                gone = page.step(seq, KNOWN[kind - FIRST], args)
                if not declined:
                    out += [(doc, at, n) for n in gone]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ends(), columns=names)

    dealt = ops.unionByName(told).repartition("doc", "page").sortWithinPartitions("doc", "page", c("kind") >= FIRST, "seq")
    return dealt.mapInPandas(of, "doc long, page long, n_left long" if declined else "doc long, page long, seq long")


def removed_paints(instructions: DataFrame, spans: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """spans: (doc, page, ox, oy, x0, y0, x1, y1), painted texts with their
    origin; regions: (doc, page, x0, y0, x1, y1); pages: (doc, page, height).

    (doc, page, seq) of paints to remove: each paint of their group says where
    it is and starts a span that lies inside a region, and the group does not
    clip. Pages count from the top, instructions from the bottom."""
    return _pages(instructions, spans, regions, pages, declined=False)


def declined_pages(instructions: DataFrame, spans: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, n_left): pages on which spans that meet a region stay, because
    no removed paint starts them; they need another way of removal."""
    types = dict(spans.dtypes)
    found = _pages(instructions, spans, regions, pages, declined=True)
    return found.withColumns({k: F.col(k).cast(types[k]) for k in ("doc", "page")})
