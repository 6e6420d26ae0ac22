"""Registered queries on loose text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import outcomes, rules, urls
from quarrymill.functions import text as tx
from quarrymill.operators import extract as ex
from quarrymill.operators import links
from quarrymill.operators import relational as rel
from quarrymill.plans.telemetry import ATT, attempts
from quarrymill.session import table

SKIPPED_PATHS = ("/wp-content/uploads/", "/assets/", "/images/", "/img/", "/static/", "/media/")
PAGE_LINKS = 50


def json_answers(spark: SparkSession, directory: str) -> DataFrame:
    """The props of events inside answers of six shapes, some of them broken."""
    kind = F.col("event_id") % 6
    answer = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\ndone")))
        .when(kind == 2, F.concat(F.lit("Answer: "), "props", F.lit(" and more {")))
        .when(kind == 3, F.replace("props", F.lit('"'), F.lit("'")))  # single quotes
        .when(kind == 4, F.concat(F.lit('{"items": [1, 2,], "in": '), "props"))  # a trailing comma, not closed
        .otherwise(F.lit("no object"))
    )
    found = ex.with_json_object(table(spark, directory, "events").select("event_id", answer.alias("answer")), "answer")
    k = F.coalesce(F.get_json_object("json", "$.k"), F.get_json_object("json", "$.in.k")).cast("int")
    return found.select("event_id", k.alias("k"), F.json_array_length(F.get_json_object("json", "$.items")).alias("items"))


def loose_lists(spark: SparkSession, directory: str) -> DataFrame:
    """Names of parts as a list, a scalar, a list of objects' first, or absent."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    both = F.array(name, F.lit(" "), F.col("p_brand"))
    json = F.when(kind == 0, F.to_json(F.struct(both.alias("items")))).when(kind == 1, F.to_json(F.struct(name.alias("items"))))
    json = json.when(kind == 2, F.to_json(F.array(F.struct(both.alias("items"))))).otherwise("{}")
    rows = table(spark, directory, "part").select("p_partkey", ex.first_object(json).alias("json"))
    return rows.select("p_partkey", F.array_join(ex.as_list(F.col("json"), "items"), "|").alias("items"))


def error_summaries(spark: SparkSession, directory: str) -> DataFrame:
    rows = attempts(spark, directory)
    ok, tried, sub = F.col("event_id") % 3, F.col("event_id") % 5, F.least(F.col("event_id") % 2, F.col("event_id") % 5)
    told = ex.error_summary(F.col("reason"), ok, tried, sub, F.lit("Connection reset"))
    return rows.select("event_id", told.alias("s")).select("event_id", "s.error_category", "s.resumo")


def thought_bodies(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").withColumn("answer", F.concat(F.lit("<think> a"), F.col("turn").cast("string"), F.lit(" </think>x<THINK>"), "text", F.lit("</think>"), "role"))
    return rows.select("conv_id", "turn", ex.thoughts(F.col("answer")).alias("thoughts"))


def tool_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Tool output of the form k=v k=v as typed columns."""
    line = F.concat(F.lit("id="), F.col("event_id").cast("string"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" type="), "event_type")
    pairs = F.str_to_map(F.col("line"), F.lit(" "), F.lit("="))
    rows = table(spark, directory, "events").select(line.alias("line"))
    return rows.select(pairs["id"].try_cast("long").alias("event_id"), pairs["user"].try_cast("long").alias("user_id"), pairs["type"].alias("event_type"), pairs["none"].alias("missing"))


def repaired_links(spark: SparkSession, directory: str) -> DataFrame:
    """Every link of every page as a URL that can be fetched."""
    found = links.extract_links(table(spark, directory, "pages"))
    return ex.with_repaired(found.select("page_id", "link"), "link").distinct()


def plain_links(spark: SparkSession, directory: str) -> DataFrame:
    """Links of the same host without query, skipped files and folders, at most 50 of a page, in order."""
    found = links.extract_links(table(spark, directory, "pages")).where("kind = 'internal'")
    bare = F.concat(urls.origin(F.col("link")), urls.path(F.col("link")))
    kept = found.select("page_id", "url", bare.alias("link")).where(~rules.contains_any(F.lower(urls.path(F.col("link"))), SKIPPED_PATHS))
    kept = kept.where((F.col("link") != F.col("url")) & (F.col("link") != F.regexp_replace("url", "/+$", ""))).select("page_id", "link").distinct()
    return links.top_links(kept.withColumn("score", F.lit(0)), PAGE_LINKS).select("page_id", "link")


def url_last_parts(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("last"))


def merged_counters(spark: SparkSession, directory: str) -> DataFrame:
    """Counters of ten instances, each partial, added up by event type."""
    parts = attempts(spark, directory).groupBy((F.col("user_id") % 10).alias("instance"), "event_type").agg(F.count("*").alias("n"), F.count("reason").alias("failed"))
    return ex.merged_counters(parts, ["event_type"], ["n", "failed"])


def profile_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """Company profiles by key: suppliers, those with open items replaced by their newer data, blank names filled in."""
    rows = table(spark, directory, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"), "s_acctbal")
    open_items = table(spark, directory, "lineitem").where("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("owed"))
    newer = rows.join(open_items, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "name", F.round(F.col("s_acctbal") + F.col("owed"), 2).alias("s_acctbal"))
    both = rel.upsert(rows, newer, "s_suppkey")
    return both.withColumn("name", tx.display_name(F.col("name"), F.lit(None).cast("string"), F.lit(""), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")))


def ordered_sources(spark: SparkSession, directory: str) -> DataFrame:
    """Each page's url, then those of its site that are not yet listed."""
    pages = table(spark, directory, "pages").select("page_id", F.array(F.col("url")).alias("own"), F.array(F.concat(urls.origin(F.col("url")), F.lit("/")), "url").alias("more"))
    return pages.select("page_id", F.array_join(F.concat("own", F.array_except("more", "own")), " ").alias("sources"))


def utilisation(spark: SparkSession, directory: str) -> DataFrame:
    """Load of each provider against its share, what is over 80 %, and the share it should get."""
    loads = table(spark, directory, "events").groupBy((F.col("user_id") % 5).alias("provider")).agg(F.count_if(F.col("event_type") != "error").alias("used"), F.count("*").alias("granted"))
    use = F.col("used") / F.col("granted")
    share = F.when(use > 0.8, F.floor(F.col("granted") * 1.2)).when(use < 0.5, F.floor(F.col("granted") * 0.9)).otherwise(F.col("granted"))
    return loads.select("provider", F.round(use, 4).alias("use"), (use > 0.8).alias("overloaded"), share.cast("long").alias("next_share"))


def token_errors(spark: SparkSession, directory: str) -> DataFrame:
    """Estimated against counted tokens (words and signs), in percent, and tokens per character."""
    counted = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))
    rows = table(spark, directory, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", tx.token_estimate(F.col("text")).alias("estimate"), counted.alias("actual"), F.char_length("text").alias("chars"))
    error = F.when(F.col("actual") == 0, 0.0).otherwise(F.round(100 * (F.col("estimate") - F.col("actual")) / F.col("actual"), 2))
    return rows.select("doc_id", error.alias("error_pct"), F.when(F.col("chars") == 0, 0.0).otherwise(F.round(F.col("actual") / F.col("chars"), 4)).alias("per_char"))


SUB = "least(event_id % 2, event_id % 5)"
PART = r"regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
ORIGIN = r"regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)"


def _links_sql() -> str:
    from quarrymill.plans.links import LINKS_SQL

    return LINKS_SQL


QUERIES = {
    "json_answers": (json_answers, "SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_id % 6 = 4 THEN 2 END AS items FROM events"),
    "loose_lists": (
        loose_lists,
        "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_name || '|' || p_brand ELSE '' END AS items FROM part",
    ),
    "error_summaries": (
        error_summaries,
        f"""SELECT event_id, coalesce(CASE WHEN reason IS NOT NULL THEN {outcomes.reason_bucket_sql("reason")} END, 'connection') AS error_category,
        CASE WHEN reason IS NOT NULL THEN 'Main page falhou: ' || {outcomes.reason_bucket_sql("reason")} WHEN event_id % 3 = 0 THEN 'Main page ok mas conteúdo insuficiente'
          WHEN event_id % 5 > 0 THEN 'Main ok, ' || event_id % 3 || ' páginas ok, ' || (event_id % 5 - {SUB}) || '/' || event_id % 5 || ' subpages falharam' ELSE 'Connection reset' END AS resumo FROM {ATT}""",
    ),
    "thought_bodies": (thought_bodies, "SELECT conv_id, turn, substr('a' || turn || chr(10) || trim(text), 1, 5000) AS thoughts FROM conversations"),
    "tool_metrics": (tool_metrics, "SELECT event_id, user_id, event_type, CAST(NULL AS VARCHAR) AS missing FROM events"),
    "repaired_links": (
        repaired_links,
        f"""WITH {_links_sql()} SELECT DISTINCT page_id, {ORIGIN.format("link")} || array_to_string(list_transform(string_split({PART.format("link")}, '/'), lambda x: url_encode(x)), '/')
          || CASE WHEN contains(link, '?') THEN '?' || regexp_extract(link, '[?]([^#]*)', 1) ELSE '' END AS link FROM extracted WHERE kind IS NOT NULL""",
    ),
    "plain_links": (
        plain_links,
        f"""WITH {_links_sql()}, b AS (SELECT DISTINCT page_id, {ORIGIN.format("link")} || {PART.format("link")} AS l, url FROM extracted WHERE kind = 'internal'),
        k AS (SELECT page_id, l AS link, row_number() OVER (PARTITION BY page_id ORDER BY l) AS n FROM b WHERE NOT {rules.sql_contains_any(f"lower({PART.format('l')})", SKIPPED_PATHS)} AND l <> url AND l <> regexp_replace(url, '/+$', ''))
        SELECT page_id, link FROM k WHERE n <= {PAGE_LINKS}""",
    ),
    "url_last_parts": (url_last_parts, "SELECT page_id, string_split(url, '/')[-1] AS last FROM pages"),
    "merged_counters": (merged_counters, f"SELECT event_type, count(*) AS n, count(reason) AS failed FROM {ATT} GROUP BY 1"),
    "profile_upsert": (
        profile_upsert,
        """WITH o AS (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS owed FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'Empresa CNPJ ' || lpad(s_suppkey::VARCHAR, 8, '0') END AS name, CASE WHEN owed IS NULL THEN s_acctbal ELSE round(s_acctbal + owed, 2) END AS s_acctbal
        FROM supplier LEFT JOIN o ON s_suppkey = l_suppkey""",
    ),
    "ordered_sources": (
        ordered_sources,
        f"SELECT page_id, CASE WHEN url = {ORIGIN.format('url')} || '/' THEN url ELSE url || ' ' || {ORIGIN.format('url')} || '/' END AS sources FROM pages",
    ),
    "utilisation": (
        utilisation,
        """WITH l AS (SELECT user_id % 5 AS provider, count(*) FILTER (event_type <> 'error') AS used, count(*) AS granted FROM events GROUP BY 1)
        SELECT provider, round(used / granted, 4) AS use, used / granted > 0.8 AS overloaded, CAST(CASE WHEN used / granted > 0.8 THEN floor(granted * 1.2) WHEN used / granted < 0.5 THEN floor(granted * 0.9) ELSE granted END AS BIGINT) AS next_share FROM l""",
    ),
    "token_errors": (
        token_errors,
        r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS actual FROM documents)
        SELECT doc_id, CASE WHEN actual = 0 THEN 0 ELSE round(100 * (chars // 3 - actual) / actual, 2) END AS error_pct, CASE WHEN chars = 0 THEN 0 ELSE round(actual / chars, 4) END AS per_char FROM d""",
    ),
}
