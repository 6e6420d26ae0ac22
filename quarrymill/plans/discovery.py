"""Registered queries on pages and site discovery (T01, P05-P10, P18, L06-L09, F06-F08, J03, J05, JN4, JN5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import pages as pg
from quarrymill.functions import rules, urls
from quarrymill.functions.text import company_base_name
from quarrymill.operators import discovery as dc
from quarrymill.operators import html as ht
from quarrymill.session import table

# Test list: domains and suffixes that occur in the input pages.
TEST_BLACKLIST = ("spam-farm.example.org", "cheap-pills.example.com", "example.net")
SUFFIXES = (" LTDA", " S.A.", " EIRELI", " ME", " EPP", " S/A")


def page_text(spark: SparkSession, directory: str) -> DataFrame:
    return ht.page_texts(table(spark, directory, "pages")).select("page_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("chars"))


def parsed_pages(spark: SparkSession, directory: str) -> DataFrame:
    found = ht.parse_pages(table(spark, directory, "pages"))
    return found.select("page_id", F.md5("text").alias("text_md5"), F.size("hrefs").alias("links"))


def page_flags(spark: SparkSession, directory: str) -> DataFrame:
    text = ht.page_texts(table(spark, directory, "pages")).select("page_id", "text", F.when(F.col("page_id") % 7 == 0, "blocked").alias("error"))
    ok, challenge, missing = pg.page_ok(F.col("text"), F.col("error")), pg.is_challenge(F.col("text")), pg.is_soft_404(F.col("text"))
    return text.select(
        "page_id", ok.alias("ok"), challenge.alias("challenge"), missing.alias("soft_404"), (ok & ~challenge & ~missing).alias("accepted"), pg.is_rejection(F.col("error")).alias("rejected"),
        pg.is_pdf(F.lit("text/html"), F.col("text")).alias("pdf"),
    )


def blacklist_filter(spark: SparkSession, directory: str) -> DataFrame:
    domains = spark.createDataFrame([(d,) for d in (*TEST_BLACKLIST, *dc.BLACKLIST)], "domain string")
    kept = dc.without_blacklisted(table(spark, directory, "pages"), "url", domains)
    return kept.select("page_id", dc.host_of(F.col("url")).alias("host"))


def _responses(spark: SparkSession, directory: str) -> DataFrame:
    """Pages as search responses of queries with ten pages each, each link twice."""
    pages = table(spark, directory, "pages").select(F.floor(F.col("page_id") / 10).alias("id"), "page_id", "url")
    twice = pages.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    entry = F.struct(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("link"), F.lit("s").alias("snippet"))
    grouped = twice.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("again", "page_id", entry.alias("e")))).alias("l"))
    return grouped.select("id", F.to_json(F.struct(F.transform("l", lambda x: x["e"]).alias("organic"))).alias("json"))


def search_results(spark: SparkSession, directory: str) -> DataFrame:
    return dc.search_results(_responses(spark, directory)).select("id", "position", "title", "link")


def search_result_filter(spark: SparkSession, directory: str) -> DataFrame:
    first = dc.first_of_each_link(dc.search_results(_responses(spark, directory)))
    domains = spark.createDataFrame([(d,) for d in TEST_BLACKLIST], "domain string")
    return dc.without_blacklisted(first, "link", domains).select("id", "position", "title", "link")


def _companies(spark: SparkSession, directory: str) -> DataFrame:
    nations = table(spark, directory, "nation").select("n_nationkey", "n_name")
    joined = table(spark, directory, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    trade = F.when(F.col("s_suppkey") % 3 == 0, F.lower("s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Loja "), F.col("s_suppkey").cast("string")))
    return joined.select("s_suppkey", F.upper(F.concat("s_name", suffix)).alias("name"), trade.alias("trade"), F.col("n_name").alias("city"))


def search_query_builder(spark: SparkSession, directory: str) -> DataFrame:
    rows = _companies(spark, directory)
    args = (F.col("name"), F.col("trade"), F.col("city"))
    both = rows.select("s_suppkey", dc.search_queries(*args).alias("q"), dc.search_query(*args).alias("one"), company_base_name(F.col("name"), True).alias("fixed_name"))
    return both.select("s_suppkey", F.get("q", 0).alias("q1"), F.get("q", 1).alias("q2"), "one", "fixed_name")


def url_variations(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "pages").select("page_id", dc.url_variations(F.col("url")).alias("v"))
    return rows.select("page_id", F.array_join("v", " ").alias("variations"))


def root_referers(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "pages").select("page_id", F.concat(urls.origin(F.col("url")), F.lit("/")).alias("referer"))


def site_decisions(spark: SparkSession, directory: str) -> DataFrame:
    """Pages as model answers of four kinds."""
    kind = F.col("page_id") % 4
    plain = F.to_json(F.struct(F.col("url").alias("site"), F.when(kind == 1, "nao").otherwise("sim").alias("site_oficial")))
    answer = F.when(kind == 2, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(kind == 3, F.lit('{"site": "nao_encontrado", "site_oficial": "sim"}')).otherwise(plain)
    return table(spark, directory, "pages").select("page_id", dc.site_decision(answer).alias("site"))


def chosen_links(spark: SparkSession, directory: str) -> DataFrame:
    """Links of each query at places that five shapes of answers give."""
    grouped = table(spark, directory, "pages").select(F.floor(F.col("page_id") / 10).alias("id"), "url").groupBy("id").agg(F.collect_list("url").alias("links"))
    answers = F.array(F.lit("[2, 1, 99]"), F.lit('{"links": [3]}'), F.lit('{"selected": [0, 1]}'), F.lit("none"), F.lit('{"picked": [3, 2]}'))
    chosen = dc.chosen_links(F.col("links"), F.element_at(answers, (F.col("id") % 5 + 1).cast("int")))
    return grouped.select("id", F.array_join(chosen, " ").alias("chosen"))


def name_domain_match(spark: SparkSession, directory: str) -> DataFrame:
    """A site's first label against the company name (our rule; models decide this elsewhere)."""
    sites = table(spark, directory, "pages").select("page_id", dc.host_of(F.col("url")).alias("host"))
    label = F.regexp_replace(F.substring_index("host", ".", -3), r"\..*$", "")
    labelled = sites.select("page_id", "host", label.alias("label"))
    return labelled.groupBy("label").agg(F.count("*").alias("pages"), F.min(F.levenshtein("label", F.substring("host", F.lit(1), F.char_length("label")))).alias("nearest"))


SQL_TEXT = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
for _tag in pg.HIDDEN_TAGS:
    SQL_TEXT = f"regexp_replace({SQL_TEXT}, '<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'gsi')"
# References may lack the semicolon, as an HTML parser reads them; ampersand last. A number ends where its digits do.
UNESCAPED = r"regexp_replace(p, '&#39(?:;|([^0-9;]|$))', '''\1', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\xa0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    UNESCAPED = f"regexp_replace({UNESCAPED}, '&{_name};?', '{_char}', 'g')"
TEXT = f"""(SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace({SQL_TEXT}, '<[^>]*>', chr(10), 'g'), chr(10)),
  lambda p: regexp_replace({UNESCAPED}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), lambda p: p <> ''), chr(10)), '') AS text FROM pages)"""
HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', ''), '^mobile\\.', '')"
LISTED = lambda host, domains: "(" + " OR ".join(f"{host} = '{d}' OR suffix({host}, '.{d}')" for d in domains) + ")"
NAMES = """(SELECT s_suppkey, upper(s_name || [' LTDA', ' S.A.', ' EIRELI', ' ME', ' EPP', ' S/A'][s_suppkey % 6 + 1]) AS name,
  coalesce(trim(CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN 'Loja ' || s_suppkey END), '') AS trade, n_name AS city FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""
CLEAN = "trim(replace(replace(replace(replace(replace(replace(name, ' LTDA', ''), ' S.A.', ''), ' EIRELI', ''), ' ME', ''), ' EPP', ''), ' S/A', ''))"
FOUND = """(SELECT page_id // 10 AS id, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY again, page_id) - 1 AS INTEGER) AS position, 't' || page_id AS title, url AS link
  FROM pages, (SELECT unnest([0, 1]) AS again))"""
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
BARE_HOST = f"replace({NETLOC}, 'www.', '')"

QUERIES = {
    "page_text": (page_text, f"SELECT page_id, md5(text) AS text_md5, length(text)::INTEGER AS chars FROM {TEXT}"),
    "parsed_pages": (
        parsed_pages,
        f"""SELECT page_id, md5(text) AS text_md5, len(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a\\s[^>]*?href\\s*=\\s*"[^"]+"'))::INTEGER AS links FROM {TEXT} JOIN pages USING (page_id)""",
    ),
    "page_flags": (
        page_flags,
        f"""WITH t AS (SELECT page_id, text, page_id % 7 = 0 AS bad, lower(text) AS low FROM {TEXT}),
        f AS (SELECT page_id, bad, length(text) >= 100 AND NOT bad AS ok, contains(low, 'cloudflare') AND {rules.sql_contains_any("low", pg.CHALLENGE_MARKS)} AS challenge,
          length(low) <= 1000 AND ({rules.sql_contains_any("low", pg.NOT_FOUND_WORDS)} OR (length(low) < 200 AND contains(low, 'not found'))) AS soft_404, prefix(text, '%PDF-') AS pdf FROM t)
        SELECT page_id, ok, challenge, soft_404, ok AND NOT challenge AND NOT soft_404 AS accepted, bad AS rejected, pdf FROM f""",
    ),
    "blacklist_filter": (
        blacklist_filter,
        f"SELECT page_id, host FROM (SELECT page_id, {HOST.format('url')} AS host FROM pages) WHERE NOT {LISTED('host', (*TEST_BLACKLIST, *dc.BLACKLIST))}",
    ),
    "search_results": (search_results, f"SELECT * FROM {FOUND}"),
    "search_result_filter": (
        search_result_filter,
        f"SELECT id, min(position) AS position, min_by(title, position) AS title, link FROM {FOUND} WHERE NOT {LISTED(HOST.format('link'), TEST_BLACKLIST)} GROUP BY id, link",
    ),
    "search_query_builder": (
        search_query_builder,
        f"""WITH c AS (SELECT *, {CLEAN} AS clean FROM {NAMES}),
        q AS (SELECT *, CASE WHEN trade <> '' THEN trim(trade || ' ' || city || ' site oficial') END AS a, CASE WHEN clean <> '' AND (trade = '' OR upper(clean) <> upper(trade)) THEN trim(clean || ' ' || city || ' site oficial') END AS b FROM c)
        SELECT s_suppkey, coalesce(a, b) AS q1, CASE WHEN a IS NOT NULL THEN b END AS q2, coalesce(a, CASE WHEN clean <> '' THEN trim(clean || ' ' || city || ' site oficial') END, CASE WHEN city <> '' THEN 'site oficial ' || city END, 'site oficial') AS one,
          trim(regexp_replace(name, '(?: LTDA| S\\.A\\.| EIRELI| ME| EPP| S/A)+\\s*$', '')) AS fixed_name FROM q""",
    ),
    "url_variations": (
        url_variations,
        f"""WITH v AS (SELECT page_id, unnest([{", ".join(f"regexp_replace('{s}://{p}' || {BARE_HOST} || {PATH}, '/+$', '')" for s in ("https", "http") for p in ("www.", ""))},
          regexp_replace(regexp_extract(url, '^([A-Za-z]+):', 1) || '://' || {NETLOC} || {PATH}, '/+$', '')]) AS u FROM pages)
        SELECT page_id, string_agg(u, ' ' ORDER BY NOT prefix(u, 'https'), NOT contains(u, 'www.'), u) AS variations FROM (SELECT DISTINCT * FROM v) GROUP BY page_id""",
    ),
    "root_referers": (root_referers, "SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || '/' AS referer FROM pages"),
    "site_decisions": (site_decisions, "SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) AND regexp_matches(url, '^https?://') THEN url END AS site FROM pages"),
    "chosen_links": (
        chosen_links,
        """WITH g AS (SELECT page_id // 10 AS id, list_sort(list(url)) AS l FROM pages GROUP BY 1)
        SELECT id, CASE id % 5 WHEN 0 THEN array_to_string([l[2], l[1]], ' ') WHEN 1 THEN coalesce(l[3], '') WHEN 2 THEN l[1] WHEN 4 THEN array_to_string([l[3], l[2]], ' ') ELSE '' END AS chosen FROM g""",
    ),
    "name_domain_match": (
        name_domain_match,
        f"""WITH h AS (SELECT page_id, {HOST.format("url")} AS host FROM pages), l AS (SELECT *, regexp_replace(array_to_string(string_split(host, '.')[-3:], '.'), '\\..*$', '') AS label FROM h)
        SELECT label, count(*) AS pages, min(levenshtein(label, substr(host, 1, length(label))))::INTEGER AS nearest FROM l GROUP BY 1""",
    ),
}
