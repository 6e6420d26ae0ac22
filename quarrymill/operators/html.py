"""Full HTML parsing where regular expressions do not do: one pass per page in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarrymill.functions.pages import HIDDEN_TAGS, OTHER_ENTITY, html_text


class PageParser(HTMLParser):
    """Text of visible elements and the href values of anchors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.texts, self.hrefs = 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "a":
            self.hrefs += [value or "" for name, value in attrs if name == "href"][-1:]

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.texts += [line for part in data.split("\n") if (line := part.strip())]


def parse_page(html: str | None) -> tuple[str, list[str]]:
    """(text, hrefs in order); a null page has neither."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.texts), parser.hrefs


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, hrefs: text and links from one parse of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_page(html) for html in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([h for _, h in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "hrefs"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, hrefs array<string>")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page: by expressions, or by the parser where a page has other entities than those know."""
    hard = F.coalesce(F.col("html").rlike(OTHER_ENTITY), F.lit(False))
    plain = pages.where(~hard).select("page_id", "url", html_text(F.col("html")).alias("text"))
    return plain.unionByName(parse_pages(pages.where(hard)).select("page_id", "url", "text"))


REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=]))")


def resolved(url: str | None, values: list[str]) -> list[str]:
    """Absolute links of href values as written: references decoded, dot segments resolved; what can't be resolved is left out.

    A reference without its semicolon counts only where no ``=`` or letter follows, so that
    ``?a=1&copy=2`` stays as it is.
    """
    links = []
    for value in values:
        href = REFERENCE.sub(lambda found: unescape(found.group()), value).strip().rstrip(",")
        if not href.startswith("#") and not href.lower().startswith("javascript:"):
            try:
                links.append(urljoin(url or "", href).rstrip(","))
            except ValueError:  # such as an open bracket in the host
                continue
    return links


@F.pandas_udf(ArrayType(StringType()))
def resolved_by_parser(url: pd.Series, values: pd.Series) -> pd.Series:
    """`resolved` for the rows that have values; null for the others, which cost next to nothing."""
    return pd.Series([None if some is None else resolved(base, list(some)) for base, some in zip(url, values)], dtype=object)
