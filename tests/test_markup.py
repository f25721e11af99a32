"""From markup to elements, plans and audit, against plain Python."""

import html
import re

import pytest
from pyspark.sql import functions as F

from paperloom import markup_queries as mq
from paperloom.sources import elements as el

BODY = " ".join(f"Sentence {i} of the text says nothing new." for i in range(260))
PAGES = [
    (1, f"<html><head><title>Motion &amp; rest</title><style>p{{}}</style></head><body><h1>Motion</h1><p>{BODY}</p><p>Why <a href=x>so</a>?<br>Because.</body>"),
    (2, "<p>One sheet only</p><script>var a = '<p>no</p>';</script><!-- <p>nor this</p> -->"),
    (3, None),
    (4, ""),
    (7, f"<title>Heat</title><p>{BODY}</p>"),
]


def plain(markup):
    """Blocks as (tag, text), with a different way of reading the markup."""
    out, tag, text = [], "", ""
    markup = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", markup or "")
    for piece in re.findall(r"<[^>]*>|[^<]+", markup):
        m = re.match(r"<(/?[a-z0-9]+)", piece)
        if m and re.fullmatch(f"/?(?:{el.PARTS})", m[1]):
            out, tag, text = [*out, (tag, text)], m[1], ""
        elif not m:
            text += piece
    return [(t, html.unescape(" ".join(x.split()))) for t, x in [*out, (tag, text)] if x.split()]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, html string")


def test_elements_are_the_text_of_the_markup(pages):
    rows = el.page_elements(pages, "page_id", "html").collect()
    assert {r["doc"] for r in rows} == {1, 2, 7}
    for doc, markup in PAGES:
        mine = sorted((r for r in rows if r["doc"] == doc), key=lambda r: (r["page"], r["nth"]))
        want = [(t, x) for t, x in plain(markup) if t != "title"]
        inner = [r for r in mine if r["tag"] not in ("head", "foot", "", "title") or r["kind"] != "rule" and r["tag"] == ""]
        words = lambda kind: " ".join(r["text"] for r in inner if r["kind"] == kind).split()
        assert words("line") == words("block") == " ".join(x for _, x in want).split()
        assert [(r["tag"], html.unescape(r["raw"])) for r in mine if r["kind"] == "block" and r["raw"]] == plain(markup)
        for r in (r for r in inner if r["kind"] == "line"):
            assert el.TOP <= r["y0"] < r["y1"] <= el.BOTTOM and r["x1"] <= el.LEFT + el.MEASURE + 0.6 * r["size"]
        sheets = {r["page"] for r in mine}
        assert sheets == set(range(1, len(sheets) + 1)) and sum(r["kind"] == "rule" for r in mine) == len(sheets)
    assert sum(r["links"] for r in rows if r["doc"] == 1) == 1
    assert {r["text"] for r in rows if r["doc"] == 1 and r["tag"] == "head"} == {"Motion & rest"}


def test_sheets_are_planned_and_audited(pages):
    lost = (F.col("doc") == 7) & (F.col("page") == 2) & (F.col("y0") > 400) & (F.col("y0") < el.BOTTOM)
    got = {(r["doc"], r["page"]): r for r in mq.audited(pages, "page_id", "html", [], lost).collect()}
    n = {d: max(p for doc, p in got if doc == d) for d in (1, 2, 7)}
    assert n[1] >= 3 and n[2] == 1 and set(got) == {(d, p) for d in n for p in range(1, n[d] + 1)}
    # heads, rules and numbers repeat over sheets; one sheet alone has nothing that repeats
    assert all(r["page_strategy"] == "standard_header_footer_replacement" and r["footer"] for (d, _), r in got.items() if d != 2)
    assert got[2, 1]["page_strategy"] == "leave_untouched"
    # of the sheet that lost its lower half nothing else changed: what is left has not moved
    assert {k: r["codes"] for k, r in got.items() if r["codes"]} == {(7, 2): "BODY_TEXT_LOSS"}
