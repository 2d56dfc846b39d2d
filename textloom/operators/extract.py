"""Title and text of pages, and the corpus made of them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import one_line
from textloom.session import keep

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Page(HTMLParser):
    """Keeps all text of a page and where the elements that may hold its body begin and end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.open: list[tuple[str, int, str]] = []
        self.title: str | None = None
        self.spans: dict[str, tuple[int, int]] = {}

    def _kind(self, tag: str, attrs: list) -> str:
        a = dict(attrs)
        if tag == "article" or tag == "body":
            return tag
        if tag == "div" and a.get("id") == "main-content":
            return "main-content"
        return "role-main" if tag == "div" and a.get("role") == "main" else ""

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            tag, start, kind = self.open.pop()
            if kind:
                first = self.spans.get(kind)
                if first is None or start < first[0]:
                    self.spans[kind] = (start, len(self.text))
            if tag == "title" and self.title is None:
                self.title = "".join(self.text[start:])

    def handle_starttag(self, tag, attrs):
        if self.title is None and self.open and self.open[-1][0] == "title":
            self.title = "".join(self.text[self.open[-1][1] :])  # up to the first element inside
        if tag in _VOID:
            return
        if self.open and self.open[-1][0] == "p" and tag in _ENDS_P or self.open and self.open[-1][0] == tag == "li":
            self._close(len(self.open) - 1)
        self.open.append((tag, len(self.text), self._kind(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return

    def handle_data(self, data):
        self.text.append(data)


def page_text(page: str) -> tuple[str, str]:
    """Title and body of a page. The body is the text of the first ``article``, else of the main
    block, else of ``body``, else of all; texts of neighbouring elements are joined as they are,
    comments left out, white space collapsed by line and blank lines dropped."""
    p = _Page()
    try:
        p.feed(page)
        p.close()
        p._close(0)
    except Exception:  # a page that can't be read is its own text
        return "", page
    for kind in ("article", "main-content", "role-main", "body"):
        if kind in p.spans:
            a, b = p.spans[kind]
            break
    else:
        a, b = 0, len(p.text)
    lines = (" ".join(line.split()) for line in "".join(p.text[a:b]).split("\n"))
    return (p.title or "").strip(), "\n".join(x for x in lines if x)


def title_and_body(html: Column) -> Column:
    """Struct of title and body; null for a null page."""

    @F.pandas_udf("title string, body string")
    def extract(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in it:
            yield pd.DataFrame([(None, None) if x is None else page_text(x) for x in pages], columns=["title", "body"])

    return extract(html)


def extracted(raw: DataFrame) -> DataFrame:
    """``raw`` with title and body, in place of columns of these names; pages without text are left
    out, as the export leaves them."""
    kept = [c for c in raw.columns if c not in ("title", "body")]
    e = raw.withColumn("_e", title_and_body(F.col("raw_html"))).select(*kept, "_e.title", "_e.body")
    return e.where(F.col("body").rlike(r"(?U)\S"))


def dense_ids(df: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """Rows numbered from 0 in ``order``, which must be unique, without bringing them to one task:
    rows are numbered within ranges, and a range's offset comes from the counts of those before it.
    The ranges are written once, so that counts and numbers are of the same ranges; a count for each
    range comes to the driver."""
    ranged = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted(ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    first = pa.table({"_part": pa.array([c.p for c in counts], pa.int64()), "_first": pa.array(list(accumulate([0, *(c.n for c in counts)]))[:-1] if counts else [], pa.int64())})
    numbered = ranged.withColumn("_part", part).join(F.broadcast(df.sparkSession.createDataFrame(first)), "_part")
    return numbered.select(*df.columns, (F.col("_first") + within).alias(name))


def corpus(raw: DataFrame, order: list[str]) -> DataFrame:
    """``(doc_id, url, title, body, text_size_bytes)`` of the pages with text."""
    e = dense_ids(extracted(raw).select("url", "title", "body", *[c for c in order if c != "url"]), order)
    return e.select("doc_id", "url", "title", "body", F.octet_length("body").alias("text_size_bytes"))


def manifest(c: DataFrame) -> DataFrame:
    return c.select("doc_id", "url", one_line(F.col("title")).alias("title"), "text_size_bytes")


def export_counts(raw: DataFrame) -> DataFrame:
    """How many pages have text to export, and how many don't."""
    body = raw.select(title_and_body(F.col("raw_html"))["body"].alias("body"))
    ok = F.coalesce(F.col("body").rlike(r"(?U)\S"), F.lit(False))
    return body.agg(F.count_if(ok).alias("exported"), F.count_if(~ok).alias("errors"))
