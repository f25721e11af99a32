"""Page elements from markup, by a table function.

A document in HTML is set in sheets of a fixed size, as a browser prints it: a
running head and a rule above, a number below, its blocks in between. One pass
over the markup gives all elements; the function is applied laterally, a row at
a time, so nothing but the rows of the result leaves a task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

WIDTH, HEIGHT = 595.0, 842.0
LEFT, TOP, BOTTOM, MEASURE = 46.0, 70.0, 780.0, 504.0
HEAD, RULE, FOOT, SMALL = 20.0, 46.0, 812.0, 10.0
SIZES = {"h1": 24.0, "h2": 18.0, "h3": 14.0}

# Elements that part blocks, and those that hold no text of a page.
PARTS = "h[1-6]|p|li|ul|ol|div|nav|article|section|aside|footer|header|form|table|tr|td|th|br|hr|title|head|body|html"
BLOCK_TAG = rf"<(/?(?:{PARTS}))(?:[ \t\r\n\f][^>]*)?/?>"
NO_TEXT = r"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG, SPACE, LINK = r"<[^>]*>", r"[ \t\r\n\f]+", r"<a\b"

_SPLIT, _NO_TEXT = re.compile(BLOCK_TAG, re.I), re.compile(NO_TEXT, re.I | re.S)
_TAG, _SPACE, _LINK = re.compile(TAG), re.compile(SPACE), re.compile(LINK, re.I)

ELEMENTS = "page long, nth long, kind string, tag string, raw string, text string, links long, size double, x0 double, y0 double, x1 double, y1 double"


def parts(markup: str) -> Iterator[tuple[str, str, int]]:
    """(tag, text with references, links) of the blocks that have text, in order;
    tag is the one before, with a slash if it is an end."""
    cut = _SPLIT.split(_NO_TEXT.sub(" ", markup))
    for tag, piece in zip(["", *cut[1::2]], cut[0::2]):
        raw = _SPACE.sub(" ", _TAG.sub("", piece)).strip(" ")
        if raw:
            yield tag.lower(), raw, len(_LINK.findall(piece))


def wrapped(text: str, size: float) -> list[str]:
    most = max(1, int(MEASURE / (0.6 * size)))
    out = [""]
    for word in text.split(" "):
        if out[-1] and len(out[-1]) + 1 + len(word) > most:
            out.append("")
        out[-1] += (" " if out[-1] else "") + word
    return out


@udtf(returnType=ELEMENTS, useArrow=True)
class PageElements:
    """(html) -> its elements: 'block' (with its raw text and links on its first
    sheet only), 'line', and 'rule'. Null or empty markup has none."""

    def eval(self, markup: str):
        if not markup:
            return
        page, y, nth, head, started = 1, TOP, 0, "", set()

        def line(kind, tag, raw, text, links, size, x0, y0, x1, y1):
            nonlocal nth
            nth += 1
            return page, nth, kind, tag, raw, text, links, size, x0, y0, x1, y1

        def frame():
            """What each sheet has above and below."""
            started.add(page)
            text = head or "untitled"
            for kind in ("block", "line"):
                yield line(kind, "head", None, text, 0, SMALL, LEFT, HEAD, LEFT + 6 * len(text), HEAD + 12)
                yield line(kind, "foot", None, f"Page {page}", 0, SMALL, 280.0, FOOT, 320.0, FOOT + 10)
            yield line("rule", "", None, "", 0, 0.0, 20.0, RULE, 575.0, RULE)

        for tag, raw, links in parts(markup):
            text = html.unescape(raw)
            if tag == "title":
                head = text[:60]
                yield line("block", tag, raw, "", links, 0.0, 0.0, 0.0, 0.0, 0.0)
                continue
            size = SIZES.get(tag, SMALL)
            held: list[str] = []
            top, first = y, True
            lines = wrapped(text, size)
            for n, piece in enumerate(lines):
                if y + size > BOTTOM:
                    if held:
                        yield line("block", tag, raw if first else None, " ".join(held), links if first else 0, size, LEFT, top, LEFT + MEASURE, y)
                        held, first = [], False
                    page, y = page + 1, TOP
                    top = y
                if page not in started:
                    yield from frame()
                yield line("line", tag, None, piece, 0, size, LEFT, y, LEFT + 0.6 * size * len(piece), y + size)
                held.append(piece)
                y += round(1.3 * size, 1)
            yield line("block", tag, raw if first else None, " ".join(held), links if first else 0, size, LEFT, top, LEFT + MEASURE, y)
            y += 4


def page_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc, page, nth, kind, ...) of all rows, see PageElements."""
    rows = pages.select(F.col(id_col).alias("doc"), F.col(html_col).alias("_html"))
    return rows.lateralJoin(PageElements(F.col("_html").outer())).drop("_html")
