"""Links of pages: extraction, filtering, scoring and the best k per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import markup, rules, urls
from quarrymill.operators.html import resolved_by_parser

#: Values whose resolution needs more than the expressions know: other references, white space and control
#: characters inside, brackets, parameters, a host that is not ASCII, schemes in odd case or without a host,
#: empty queries and fragments. And the bases that the expressions know.
ODD_HREF = (
    rf"{markup.OTHER_REFERENCE}|[\x00-\x20\x7f-\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\[\]\\]|^[^?#]*;"
    r"|^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*[^\x00-\x7f]|^(?i:https?):(?!//)|^(?!https?:)(?i:https?):|[?#]$|\?#"
)
PLAIN_BASE = r"^https?://[!-:<-Z^-~]+$"
STRIP = r"(?U)^\s+|\s+$"


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, url, hrefs (values to resolve by expressions), odd (values for Python) of each page.

    All tags are read by the JVM tokenizer. Trailing commas go; ``#`` and ``javascript:`` are
    skipped. An anchor with an empty href links to the page itself; one without has no link.
    """
    pages = pages.select("page_id", "url", markup.without_raw_text(F.col("html")).alias("body"))
    values = F.transform(markup.tags(F.col("body"), "a"), lambda tag: markup.attribute(tag, "href"))
    found = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.regexp_replace(F.regexp_replace(v, STRIP, ""), ",+$", ""))
    wanted = F.filter(found, lambda v: ~F.startswith(v, F.lit("#")) & ~F.startswith(F.lower(v), F.lit("javascript:")))
    rows = pages.select("page_id", "url", F.array_distinct(wanted).alias("all"), F.coalesce(F.col("url").rlike(PLAIN_BASE), F.lit(False)).alias("plain"))
    is_odd = lambda v: ~F.col("plain") | v.rlike(ODD_HREF)
    easy = F.transform(F.filter("all", lambda v: ~is_odd(v)), lambda v: markup.decoded(v))
    return rows.select("page_id", "url", easy.alias("hrefs"), F.filter("all", is_odd).alias("odd"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page: page_id, url, link, kind ('document' or 'internal').

    The tokenizer reads tags in any form that a parser reads, and expressions resolve their
    values; only odd values (`ODD_HREF`) go to Python, none on most pages. Skipped are links to
    the page itself with another fragment, excluded file types, other hosts, and image names in
    the query. A null page has no links. Each row is a page.
    """
    easy = F.transform("hrefs", lambda h: F.regexp_replace(urls.resolve_from(F.col("at"), h), ",+$", ""))
    odd = resolved_by_parser(F.when(F.size("odd") > 0, F.col("url")), F.when(F.size("odd") > 0, F.col("odd")))
    # Links repeat within a page, so they are made distinct in its row: no shuffle.
    links = F.array_distinct(F.concat(easy, F.coalesce(odd, F.array().cast("array<string>"))))
    values = hrefs(pages).withColumn("at", urls.base_parts(F.col("url")))
    found = values.select("page_id", "url", F.explode(links).alias("link"))
    same_page = F.contains("link", F.lit("#")) & (urls.without_fragment(F.col("link")) == urls.without_fragment(F.col("url")))
    path = F.lower(urls.path(F.col("link")))
    internal = (
        ~rules.ends_with_any(path, rules.EXCLUDED_EXTENSIONS)
        & (urls.netloc(F.col("link")) == urls.netloc(F.col("url")))
        & ~rules.contains_any(F.lower(urls.query(F.col("link"))), rules.QUERY_IMAGE_EXTENSIONS)
    )
    kind = F.when(rules.ends_with_any(path, rules.DOCUMENT_EXTENSIONS), "document").when(internal, "internal")
    return found.where(~same_page).withColumn("kind", kind).where(F.col("kind").isNotNull())


def link_routes(pages: DataFrame) -> DataFrame:
    """One row: pages, pages with odd values, values, and odd values, which alone leave the JVM."""
    sizes = hrefs(pages).select(F.size("hrefs").alias("n"), F.size("odd").alias("odd"))
    counts = F.count("*").alias("pages"), F.count_if(F.col("odd") > 0).alias("odd_pages"), F.sum(F.col("n") + F.col("odd")).alias("hrefs"), F.sum("odd").alias("odd_hrefs")
    return sizes.where(F.col("n") >= 0).agg(*counts)


def html_links(links: DataFrame) -> DataFrame:
    """Only links that can hold HTML: no documents, excluded types or image names in the query."""
    path = F.lower(urls.path(F.col("link")))
    bad = (
        rules.ends_with_any(path, rules.DOCUMENT_EXTENSIONS + rules.EXCLUDED_EXTENSIONS)
        | rules.contains_any(F.lower(urls.query(F.col("link"))), rules.FILTER_IMAGE_EXTENSIONS)
    )
    return links.where(~bad & (F.col("link") != ""))


def link_score(link: Column, paging: bool = True) -> Column:
    """Score of a link: word lists, path depth and, unless ``paging`` is off, paging marks."""
    low = rules.contains_any(F.lower(link), rules.LOW_PRIORITY_WORDS)
    high = rules.contains_any(F.lower(link), rules.HIGH_PRIORITY_WORDS)
    score = (
        F.when(low, rules.LOW_PENALTY).otherwise(0)
        + F.when(high, rules.HIGH_BONUS).otherwise(0)
        - F.size(F.split(urls.path(link), "/", -1))
    )
    if paging:
        score += F.when(rules.contains_any(F.lower(link), rules.PAGING_WORDS) & ~low, rules.PAGING_BONUS).otherwise(0)
    return score


def score_links(links: DataFrame, paging: bool = True) -> DataFrame:
    """page_id, link, score of links above the floor, without links to the page itself."""
    own = F.regexp_replace("link", "/+$", "") == F.regexp_replace("url", "/+$", "")
    return (
        links.where(~own)
        .select("page_id", "link", link_score(F.col("link"), paging).alias("score"))
        .where(F.col("score") > rules.LOWEST_SCORE)
    )


def top_links(scored: DataFrame, k: int) -> DataFrame:
    """The best k links of each page: page_id, rank from 1, link, score; ties by link."""
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.col("link"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
