"""Registered queries on links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import rules
from quarrymill.operators import links
from quarrymill.session import table

MAX_LINKS = 15


def page_links(spark: SparkSession, directory: str) -> DataFrame:
    return links.extract_links(table(spark, directory, "pages")).select("page_id", "link", "kind")


#: The same links written in other ways, by page_id % 6: as given, in upper case, in single quotes, bare,
#: beside look-alikes, and with a reference that only the full table knows.
MARKUP = {
    1: r"""<A class="k" HREF = "$1" """,
    2: r"""<a id=x href='$1'""",
    3: r"""<a href=$1 """,
    4: r"""<a data-href="/wrong" title="a > b <a href=/in>" href="$1" disabled""",
    5: r"""<a href="/first" href="$1&eacute;" """,
}


def odd_markup(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages")
    html = F.col("html")
    for part, form in MARKUP.items():
        html = F.when(F.col("page_id") % 6 == part, F.regexp_replace("html", r'<a\s+href="([^"]*)"', form)).otherwise(html)
    return pages.withColumn("html", html)


def odd_markup_links(spark: SparkSession, directory: str) -> DataFrame:
    """Links don't depend on how their tags are written."""
    return links.extract_links(odd_markup(spark, directory)).select("page_id", "link", "kind")


def link_routes(spark: SparkSession, directory: str) -> DataFrame:
    """How many pages and values leave the JVM: here only those of MARKUP's last form."""
    return links.link_routes(odd_markup(spark, directory))


def html_page_links(spark: SparkSession, directory: str) -> DataFrame:
    found = links.extract_links(table(spark, directory, "pages"))
    return links.html_links(found).select("page_id", "link")


def link_scores(spark: SparkSession, directory: str) -> DataFrame:
    found = links.html_links(links.extract_links(table(spark, directory, "pages")))
    return links.score_links(found)


def link_scores_without_paging(spark: SparkSession, directory: str) -> DataFrame:
    found = links.html_links(links.extract_links(table(spark, directory, "pages")))
    return links.score_links(found, paging=False)


def top_links(spark: SparkSession, directory: str) -> DataFrame:
    return links.top_links(link_scores(spark, directory), MAX_LINKS)


PATH_SQL = r"lower(regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"
QUERY_SQL = r"lower(regexp_extract(link, '^[^?#]*\?([^#]*)', 1))"
HOST_SQL = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"

LINKS_SQL = rf"""
hrefs AS (
  SELECT page_id, url,
    regexp_replace(trim(unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"', 1))), ',+$', '') AS href
  FROM pages
), resolved AS (
  SELECT page_id, url, regexp_replace(CASE
    WHEN href = '' THEN url
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href
    WHEN prefix(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) || ':' || href
    WHEN prefix(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || href
    WHEN prefix(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END, ',+$', '') AS link
  FROM hrefs WHERE NOT prefix(href, '#') AND NOT prefix(lower(href), 'javascript:')
), extracted AS (
  SELECT DISTINCT page_id, url, link, CASE
    WHEN {rules.sql_ends_with_any(PATH_SQL, rules.DOCUMENT_EXTENSIONS)} THEN 'document'
    WHEN NOT {rules.sql_ends_with_any(PATH_SQL, rules.EXCLUDED_EXTENSIONS)}
      AND {HOST_SQL.format("link")} = {HOST_SQL.format("url")}
      AND NOT {rules.sql_contains_any(QUERY_SQL, rules.QUERY_IMAGE_EXTENSIONS)} THEN 'internal' END AS kind
  FROM resolved
  WHERE NOT (contains(link, '#') AND regexp_replace(link, '#.*$', '') = regexp_replace(url, '#.*$', ''))
), html AS (
  SELECT page_id, url, link FROM extracted
  WHERE kind IS NOT NULL AND link <> ''
    AND NOT {rules.sql_ends_with_any(PATH_SQL, rules.DOCUMENT_EXTENSIONS + rules.EXCLUDED_EXTENSIONS)}
    AND NOT {rules.sql_contains_any(QUERY_SQL, rules.FILTER_IMAGE_EXTENSIONS)}
)"""


ODD_SQL = r"""written AS (SELECT page_id, url, CASE WHEN page_id % 6 = 5 THEN regexp_replace(html, '<a\s+href="([^"]*)"', '<a href="\1é"', 'g') ELSE html END AS html FROM base)"""


def _scored(paging: bool) -> str:
    low = rules.sql_contains_any("lower(link)", rules.LOW_PRIORITY_WORDS)
    high = rules.sql_contains_any("lower(link)", rules.HIGH_PRIORITY_WORDS)
    bonus = f"+ CASE WHEN {rules.sql_contains_any('lower(link)', rules.PAGING_WORDS)} AND NOT {low} THEN {rules.PAGING_BONUS} ELSE 0 END"
    return f"""scored AS (
  SELECT page_id, link, CAST(CASE WHEN {low} THEN {rules.LOW_PENALTY} ELSE 0 END
    + CASE WHEN {high} THEN {rules.HIGH_BONUS} ELSE 0 END
    - len(string_split({PATH_SQL}, '/')) {bonus if paging else ""} AS INTEGER) AS score
  FROM html WHERE regexp_replace(link, '/+$', '') <> regexp_replace(url, '/+$', '')
), kept AS (SELECT * FROM scored WHERE score > {rules.LOWEST_SCORE})"""


QUERIES = {
    "page_links": (page_links, f"WITH {LINKS_SQL} SELECT page_id, link, kind FROM extracted WHERE kind IS NOT NULL"),
    "odd_markup_links": (
        odd_markup_links,
        f"WITH base AS (SELECT * FROM pages), {ODD_SQL}, {LINKS_SQL.replace('FROM pages', 'FROM written')} SELECT page_id, link, kind FROM extracted WHERE kind IS NOT NULL",
    ),
    "link_routes": (
        link_routes,
        rf"""WITH h AS (SELECT page_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"', 1), lambda h: regexp_replace(trim(h), ',+$', '')),
          lambda h: NOT prefix(h, '#') AND NOT prefix(lower(h), 'javascript:')))) AS href FROM pages)
        SELECT (SELECT count(html) FROM pages) AS pages, count(DISTINCT page_id) FILTER (page_id % 6 = 5) AS odd_pages, count(*) AS hrefs, count(*) FILTER (page_id % 6 = 5) AS odd_hrefs FROM h""",
    ),
    "html_page_links": (html_page_links, f"WITH {LINKS_SQL} SELECT page_id, link FROM html"),
    "link_scores": (link_scores, f"WITH {LINKS_SQL}, {_scored(True)} SELECT page_id, link, score FROM kept"),
    "link_scores_without_paging": (
        link_scores_without_paging,
        f"WITH {LINKS_SQL}, {_scored(False)} SELECT page_id, link, score FROM kept",
    ),
    "top_links": (
        top_links,
        f"""WITH {LINKS_SQL}, {_scored(True)}, ranked AS (
  SELECT page_id, link, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link) AS INTEGER) AS rank
  FROM kept) SELECT page_id, link, score, rank FROM ranked WHERE rank <= {MAX_LINKS}""",
    ),
}
