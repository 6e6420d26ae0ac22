"""Registered chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import CHARS_PER_TOKEN, EFFECTIVE_MAX_TOKENS
from quarrymill.operators import chunks as ck
from quarrymill.plans.documents import DOCS, FIRST
from quarrymill.session import table

SMALL = 4000
#: Consecutive doc_ids whose pages of one source make a site.
CRAWL = 320


def site_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as pages of crawls: a site is what a source has in a block of CRAWL doc_ids, so no site is larger than that."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    site = F.concat_ws("-", "source", F.floor(F.col("doc_id") / CRAWL).cast("string"))
    return table(spark, directory, "documents").select(site.alias("site"), F.col("doc_id").alias("pos"), url.alias("url"), F.coalesce("text", F.lit("")).alias("text"))


def marked_documents(spark: SparkSession, directory: str) -> DataFrame:
    return ck.marked_documents(site_pages(spark, directory), "site").select("site", F.md5("text").alias("text_md5"), F.char_length("text").alias("chars"))


def split_marked(spark: SparkSession, directory: str) -> DataFrame:
    back = ck.split_marked(ck.marked_documents(site_pages(spark, directory), "site"), "site")
    return back.select("site", "pos", "url", F.char_length("page").alias("chars"))


def greedy_packing(spark: SparkSession, directory: str) -> DataFrame:
    pieces = site_pages(spark, directory).select("site", "pos", F.lit(0).alias("part"), F.floor(F.char_length("text") / 3).alias("tokens"))
    index = ck.greedy_chunks(pieces, "site", "tokens", SMALL)
    return index.join(pieces, ["site", "pos", "part"]).groupBy("site", "chunk_index").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def chunked_sites(spark: SparkSession, directory: str) -> DataFrame:
    done = ck.chunk_pages(site_pages(spark, directory), "site")
    return done.select("site", "chunk_index", "total_chunks", F.md5("content").alias("content_md5"), "tokens", "page_source", ck.chunk_issues(F.col("tokens"), F.col("content")).alias("issues"))


def chunk_stats(spark: SparkSession, directory: str) -> DataFrame:
    done = ck.chunk_pages(site_pages(spark, directory), "site", SMALL)
    return done.groupBy("site").agg(F.count("*").alias("chunks"), F.max("tokens").alias("most"), F.round(F.avg("tokens"), 4).alias("avg_tokens"), F.sum(F.char_length("content")).alias("chars"))


def processed_content(spark: SparkSession, directory: str) -> DataFrame:
    """Sites' raw marked texts, preprocessed, chunked and validated in one go."""
    done = ck.process_content(ck.marked_documents(site_pages(spark, directory), "site"), "site", SMALL)
    return done.select("site", "chunk_index", "total_chunks", "tokens", F.char_length("content").alias("chars"), F.size(F.split("page_source", ",")).alias("sources"))


def enforced_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as chunks of any size, split where they are over the limit and numbered anew."""
    given = site_pages(spark, directory).select("site", F.col("pos").alias("chunk_index"), F.col("text").alias("content"), F.col("url").alias("page_source"))
    done = ck.validated_chunks(given, "site", SMALL)
    return done.select("site", "chunk_index", "total_chunks", "tokens", F.md5("content").alias("content_md5"), "page_source", "issues")


def page_issues(spark: SparkSession, directory: str) -> DataFrame:
    pages = site_pages(spark, directory)
    return pages.select(F.col("pos").alias("doc_id"), ck.chunk_issues(F.floor(F.char_length("text") / 3), F.col("text")).alias("issues"))


PAGES = f"(SELECT source || '-' || CAST(floor(doc_id / {CRAWL}) AS BIGINT) AS site, doc_id, 'https://' || source || '.example.com/' || doc_id AS url, coalesce(text, '') AS text FROM documents)"


def _cut(at: str, limit: int = 3 * SMALL) -> str:
    """Where a piece that starts at ``at`` ends: after the last paragraph, line or space of its second half."""
    window = f"reverse(substr(text, {at} + {limit // 2} + 1, {limit - limit // 2}))"
    steps = " ".join(f"WHEN contains({window}, {mark}) THEN {at} + {limit} - strpos({window}, {mark}) + 1" for mark in ("chr(10) || chr(10)", "chr(10)", "' '"))
    return f"CASE WHEN length(text) - {at} <= {limit} THEN length(text) {steps} ELSE {at} + {limit} END"


LIMIT, WHOLE = 3 * SMALL, CHARS_PER_TOKEN * EFFECTIVE_MAX_TOKENS
STATS_SQL = f"""WITH RECURSIVE cuts AS (SELECT site, doc_id, text, 0 AS part, 0 AS a, {_cut("0")} AS b FROM {PAGES}
  UNION ALL SELECT site, doc_id, text, part + 1, b, {_cut("b")} FROM cuts WHERE b < length(text)),
d AS (SELECT site, b - a AS n, row_number() OVER (PARTITION BY site ORDER BY doc_id, part) AS k FROM cuts),
w AS (SELECT site, k, n, n AS used, 1 AS chunk_index FROM d WHERE k = 1
  UNION ALL SELECT d.site, d.k, d.n, CASE WHEN w.used + 2 + d.n > {LIMIT + 2} THEN d.n ELSE w.used + 2 + d.n END, CASE WHEN w.used + 2 + d.n > {LIMIT + 2} THEN w.chunk_index + 1 ELSE w.chunk_index END FROM w JOIN d ON d.site = w.site AND d.k = w.k + 1),
c AS (SELECT site, chunk_index, max(used) AS n FROM w GROUP BY 1, 2)
SELECT site, count(*) AS chunks, max(n // 3)::BIGINT AS most, round(avg(n // 3), 4) AS avg_tokens, sum(n)::BIGINT AS chars FROM c GROUP BY 1"""
#: Pages of the preprocessed marked texts of sites; the first part of a text has nothing before its marker.
CLEAN_SQL = f"""WITH RECURSIVE {FIRST.replace(DOCS, f"(SELECT site AS doc_id, string_agg('--- PAGE START: ' || url || ' ---' || chr(10) || text || chr(10) || '--- PAGE END ---', chr(10) || chr(10) ORDER BY doc_id) AS text FROM {PAGES} GROUP BY 1)")},
w0 AS (SELECT doc_id AS site, regexp_replace(regexp_replace(s.text, '[ \\t\\r\\x0b\\x0c\\x{{a0}}]+(\\n|$)', '\\1', 'g') || chr(10), '([^\\n])\\n{{3,}}', '\\1' || chr(10) || chr(10) || chr(10), 'g') AS text FROM s),
parts AS (SELECT site, generate_subscripts(ps, 1) AS doc_id, unnest(ps) AS page FROM (SELECT site, string_split(text, '--- PAGE START: ') AS ps FROM w0)),
pages0 AS (SELECT site, doc_id, '--- PAGE START: ' || page AS text, regexp_extract(page, '^([^\\n]+?)(?: ---)?(?:\\n|$)', 1) AS url FROM parts WHERE doc_id > 1)"""
PROCESSED_SQL = f"""{CLEAN_SQL}, cuts AS (SELECT site, doc_id, url, text, 0 AS part, 0 AS a, {_cut("0")} AS b FROM pages0
  UNION ALL SELECT site, doc_id, url, text, part + 1, b, {_cut("b")} FROM cuts WHERE b < length(text)),
n AS (SELECT site, url, b - a AS n, row_number() OVER (PARTITION BY site ORDER BY doc_id, part) AS k FROM cuts),
w AS (SELECT site, k, n AS used, 1 AS chunk_index FROM n WHERE k = 1
  UNION ALL SELECT d.site, d.k, CASE WHEN w.used + 2 + d.n > {LIMIT + 2} THEN d.n ELSE w.used + 2 + d.n END, CASE WHEN w.used + 2 + d.n > {LIMIT + 2} THEN w.chunk_index + 1 ELSE w.chunk_index END FROM w JOIN n d ON d.site = w.site AND d.k = w.k + 1)
SELECT site, chunk_index, (count(*) OVER (PARTITION BY site))::INTEGER AS total_chunks, max(used) // 3 AS tokens, max(used)::INTEGER AS chars, least(count(DISTINCT url), 5)::INTEGER AS sources FROM w JOIN n USING (site, k) GROUP BY site, chunk_index"""
ENFORCED_SQL = f"""WITH RECURSIVE cuts AS (SELECT site, doc_id, url, text, 0 AS part, 0 AS a, {_cut("0")} AS b FROM {PAGES}
  UNION ALL SELECT site, doc_id, url, text, part + 1, b, {_cut("b")} FROM cuts WHERE b < length(text)),
c AS (SELECT site, doc_id, part, url, substr(text, a + 1, b - a) AS content, length(text) // 3 > {SMALL} AS over FROM cuts),
k AS (SELECT site, doc_id, part, url, content FROM c WHERE over AND regexp_matches(content, '\\S') UNION ALL SELECT site, doc_id, 0, url, coalesce(text, '') FROM {PAGES} WHERE length(text) // 3 <= {SMALL})
SELECT site, row_number() OVER (PARTITION BY site ORDER BY doc_id, part)::INTEGER AS chunk_index, (count(*) OVER (PARTITION BY site))::INTEGER AS total_chunks, length(content) // 3 AS tokens, md5(content) AS content_md5, url AS page_source,
  concat_ws(',', CASE WHEN trim(content) = '' THEN 'empty' END, CASE WHEN length(trim(content)) < 500 THEN 'short' END) AS issues FROM k"""


QUERIES = {
    "processed_content": (processed_content, PROCESSED_SQL),
    "enforced_chunks": (enforced_chunks, ENFORCED_SQL),
    "marked_documents": (
        marked_documents,
        f"""WITH m AS (SELECT site, string_agg('--- PAGE START: ' || url || ' ---' || chr(10) || text || chr(10) || '--- PAGE END ---', chr(10) || chr(10) ORDER BY doc_id) AS text FROM {PAGES} GROUP BY 1)
        SELECT site, md5(text) AS text_md5, length(text)::INTEGER AS chars FROM m""",
    ),
    "split_marked": (
        split_marked,
        f"""SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY doc_id) - 1 AS INTEGER) AS pos, url,
        (length('--- PAGE START: ' || url || ' ---' || text || '--- PAGE END ---') + 2 + CASE WHEN lead(doc_id) OVER (PARTITION BY site ORDER BY doc_id) IS NULL THEN 0 ELSE 2 END)::INTEGER AS chars FROM {PAGES}""",
    ),
    "greedy_packing": (
        greedy_packing,
        f"""WITH RECURSIVE d AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY doc_id) AS k, length(text) // 3 AS n FROM {PAGES}),
        w AS (SELECT site, k, n, n AS used, 1 AS chunk_index FROM d WHERE k = 1
          UNION ALL SELECT d.site, d.k, d.n, CASE WHEN w.used + d.n > {SMALL} THEN d.n ELSE w.used + d.n END, CASE WHEN w.used + d.n > {SMALL} THEN w.chunk_index + 1 ELSE w.chunk_index END FROM w JOIN d ON d.site = w.site AND d.k = w.k + 1)
        SELECT site, chunk_index, count(*) AS docs, sum(n)::BIGINT AS tokens FROM w GROUP BY 1, 2""",
    ),
    "chunked_sites": (
        chunked_sites,
        f"""WITH RECURSIVE cuts AS (SELECT site, doc_id, url, text, 0 AS part, 0 AS a, {_cut("0", WHOLE)} AS b FROM {PAGES}
          UNION ALL SELECT site, doc_id, url, text, part + 1, b, {_cut("b", WHOLE)} FROM cuts WHERE b < length(text)),
        d AS (SELECT site, doc_id, url, substr(text, a + 1, b - a) AS text, row_number() OVER (PARTITION BY site ORDER BY doc_id, part) AS k, b - a AS n FROM cuts),
        w AS (SELECT site, k, n AS used, 1 AS chunk_index FROM d WHERE k = 1
          UNION ALL SELECT d.site, d.k, CASE WHEN w.used + 2 + d.n > {WHOLE + 2} THEN d.n ELSE w.used + 2 + d.n END, CASE WHEN w.used + 2 + d.n > {WHOLE + 2} THEN w.chunk_index + 1 ELSE w.chunk_index END FROM w JOIN d ON d.site = w.site AND d.k = w.k + 1),
        u AS (SELECT site, chunk_index, array_to_string(list(url ORDER BY k)[:5], ',') AS page_source FROM (SELECT site, chunk_index, url, min(k) AS k FROM w JOIN d USING (site, k) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c AS (SELECT site, chunk_index, string_agg(text, chr(10) || chr(10) ORDER BY k) AS content, any_value(page_source) AS page_source FROM w JOIN d USING (site, k) JOIN u USING (site, chunk_index) GROUP BY 1, 2)
        SELECT site, chunk_index, CAST(count(*) OVER (PARTITION BY site) AS INTEGER) AS total_chunks, md5(content) AS content_md5, length(content) // 3 AS tokens, page_source,
          concat_ws(',', CASE WHEN length(content) // 3 > 14705 THEN 'over_effective' END, CASE WHEN trim(content) = '' THEN 'empty' END, CASE WHEN length(trim(content)) < 500 THEN 'short' END) AS issues FROM c""",
    ),
    "chunk_stats": (chunk_stats, STATS_SQL),
    "page_issues": (
        page_issues,
        f"""SELECT doc_id, concat_ws(',', CASE WHEN length(text) // 3 > 14705 THEN 'over_effective' END, CASE WHEN length(text) // 3 > 20000 THEN 'over_max' END, CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN length(trim(text)) < 500 THEN 'short' END) AS issues FROM {PAGES}""",
    ),
}
