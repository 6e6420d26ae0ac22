"""Registered queries on document text (T04-T09, T19, T21-T23, A19, A20, A23, P15, F01-F06, F12-F15, F18, AR1, AR8, N01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.functions.rules import quote
from quarrymill.operators import text_lines as tl
from quarrymill.session import table

SMALL_BASE = 2000


def _docs(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def message_tokens(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").groupBy("conv_id")
    return rows.agg(tx.message_tokens(F.sum(F.char_length("text")), F.count("*")).alias("tokens"))


def doc_tokens_margin(spark: SparkSession, directory: str) -> DataFrame:
    rows = _docs(spark, directory).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.repetition_rate(F.col("text")).alias("repetition"))
    limit = tx.adjusted_limit(F.col("tokens"), F.col("repetition"), SMALL_BASE)
    return rows.select("doc_id", "tokens", F.round("repetition", 6).alias("repetition"), limit.alias("token_limit"), (F.col("tokens") + tx.SYSTEM_OVERHEAD > tx.EFFECTIVE_MAX_TOKENS).alias("over"))


def output_budget(spark: SparkSession, directory: str) -> DataFrame:
    rows = _docs(spark, directory).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return rows.select("doc_id", tx.output_budget(F.col("tokens"), F.lit(False)).cast("long").alias("first"), tx.output_budget(F.col("tokens"), F.lit(True)).cast("long").alias("retry"))


def content_quality(spark: SparkSession, directory: str) -> DataFrame:
    return _docs(spark, directory).select("doc_id", *[c.alias(name) for name, c in tl.quality_counters(F.col("text")).items()])


def line_dedup_stats(spark: SparkSession, directory: str) -> DataFrame:
    return tl.preprocess(_docs(spark, directory)).drop("text", "chars_after")


def consecutive_dedup_stats(spark: SparkSession, directory: str) -> DataFrame:
    return tl.preprocess(_docs(spark, directory), "consecutive").select("doc_id", "original", "removed")


def preprocessed_text(spark: SparkSession, directory: str) -> DataFrame:
    return tl.preprocess(_docs(spark, directory)).select("doc_id", F.md5("text").alias("text_md5"), "chars_after")


def loop_detector(spark: SparkSession, directory: str) -> DataFrame:
    return tl.loop_flags(_docs(spark, directory))


def normal_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Normal forms of each line of each document: generic, e-mail, phone, service label, cache key."""
    lines = _docs(spark, directory).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.col("line")
    return lines.select(
        "doc_id",
        "pos",
        tx.collapse_spaces(line).alias("generic"),
        tx.normal_email(line).alias("email"),
        tx.normal_phone(line).alias("phone"),
        tx.service_label(line).alias("service"),
        tx.shortened(line, 40).alias("short"),
        F.md5(F.concat(F.lower(F.trim(line)), F.lit(":25"))).alias("cache_key"),
    )


def normal_page_urls(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "pages").select("page_id", tx.normal_url(F.col("url")).alias("url"))


def display_names(spark: SparkSession, directory: str) -> DataFrame:
    """Name fallbacks: parts as companies whose name, tagline and description are sometimes blank."""
    part = table(spark, directory, "part")
    odd = lambda n, c: F.when(F.col("p_partkey") % n != 0, F.col(c)).otherwise(" ")
    name = tx.display_name(odd(2, "p_name"), odd(3, "p_type"), F.concat_ws(". ", odd(5, "p_brand"), "p_name"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return part.select("p_partkey", name.alias("name"))


def employee_ranges(spark: SparkSession, directory: str) -> DataFrame:
    part = table(spark, directory, "part")
    text = F.when(F.col("p_size") % 3 == 0, F.concat_ws("-", F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("+")))
    least, most = tx.employee_range(F.col("span"))
    return part.select("p_partkey", text.alias("span")).select("p_partkey", "span", least.alias("least"), most.alias("most"))


DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
LINES = "CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END"


def _ladder(value: str, margins: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} > {b} THEN {m}::DOUBLE" for b, m in margins) + " ELSE 0.0::DOUBLE END"


BARE = r"regexp_replace(line, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '')"
EXPLODED = f"""d AS (SELECT doc_id, text, {LINES} AS ls FROM {DOCS}),
e AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d), k AS (SELECT *, {BARE} AS key FROM e)"""
FIRST = f"""{EXPLODED}, f AS (SELECT *, length(key) < 5 OR row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1 AS keep FROM k),
s AS (SELECT doc_id, count(*) FILTER (keep) AS kept, string_agg(line, chr(10) ORDER BY pos) FILTER (keep) AS text FROM f GROUP BY doc_id)"""

QUERIES = {
    "message_tokens": (message_tokens, "SELECT conv_id, CAST(greatest(100, floor(sum(length(text)) / 3) + 100 * count(*)) AS BIGINT) AS tokens FROM conversations GROUP BY 1"),
    "doc_tokens_margin": (
        doc_tokens_margin,
        f"""WITH r AS (SELECT doc_id, CAST(floor(length(text) / 3) AS BIGINT) AS tokens, CASE WHEN len(ls) = 0 THEN 0 ELSE (len(ls) - len(list_distinct(ls))) / len(ls) END AS rep FROM (SELECT doc_id, text, {LINES} AS ls FROM {DOCS})),
        m AS (SELECT *, CAST(floor({SMALL_BASE} * (1 - greatest({_ladder("rep", tx.REPETITION_MARGINS)}, {_ladder("tokens", tx.SIZE_MARGINS)}))) AS BIGINT) AS plain FROM r)
        SELECT doc_id, tokens, round(rep, 6) AS repetition, CASE WHEN tokens > plain THEN CAST(floor({SMALL_BASE} * (1 - least(1 - tokens / {SMALL_BASE}::DOUBLE + 0.05::DOUBLE, 0.30::DOUBLE))) AS BIGINT) ELSE plain END AS token_limit,
          tokens + 2500 > 14705 AS "over" FROM m""",
    ),
    "output_budget": (
        output_budget,
        f"""WITH b AS (SELECT doc_id, CASE WHEN length(text) // 3 < 3000 THEN 900 WHEN length(text) // 3 < 8000 THEN 1400 ELSE 2200 END AS b FROM {DOCS})
        SELECT doc_id, b::BIGINT AS first, floor(b * 0.75)::BIGINT AS retry FROM b""",
    ),
    "content_quality": (
        content_quality,
        f"""WITH d AS (SELECT *, string_split(text, chr(10)) AS ls FROM {DOCS})
        SELECT doc_id, length(text)::INTEGER AS total_length, len(regexp_extract_all(text, '\\n'))::INTEGER AS newlines, len(regexp_extract_all(text, '\\t'))::INTEGER AS tabs, len(regexp_extract_all(text, ' '))::INTEGER AS spaces,
          len(regexp_extract_all(text, '\\n{{3,}}'))::INTEGER AS blank_runs, len(regexp_extract_all(text, ' {{3,}}'))::INTEGER AS space_runs, len(regexp_extract_all(text, '[^\\x00-\\x7f]'))::INTEGER AS non_ascii,
          len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))::INTEGER AS control,
          len(list_filter(ls, lambda x, i: i > 1 AND x = ls[i - 1] AND trim(x) <> ''))::INTEGER AS duplicate_lines, len(ls)::INTEGER AS total_lines, round((length(text) - len(ls) + 1) / len(ls), 4) AS avg_line_length FROM d""",
    ),
    "line_dedup_stats": (
        line_dedup_stats,
        f"""WITH {FIRST} SELECT doc_id, len(ls)::INTEGER AS original, coalesce(kept, 0)::INTEGER AS "unique", (len(ls) - coalesce(kept, 0))::INTEGER AS removed,
        CASE WHEN len(ls) = 0 THEN 0 ELSE round(100 * (len(ls) - coalesce(kept, 0)) / len(ls), 1) END AS reduction, length(d.text)::INTEGER AS chars_before FROM d LEFT JOIN s USING (doc_id)""",
    ),
    "consecutive_dedup_stats": (
        consecutive_dedup_stats,
        f"""WITH {EXPLODED}, f AS (SELECT doc_id, length(key) < 5 OR key IS DISTINCT FROM lag(key) OVER (PARTITION BY doc_id ORDER BY pos) AS keep FROM k),
        s AS (SELECT doc_id, count(*) FILTER (NOT keep) AS removed FROM f GROUP BY doc_id)
        SELECT doc_id, len(ls)::INTEGER AS original, coalesce(removed, 0)::INTEGER AS removed FROM d LEFT JOIN s USING (doc_id)""",
    ),
    "preprocessed_text": (
        preprocessed_text,
        f"""WITH {FIRST}, w AS (SELECT doc_id, CASE WHEN coalesce(s.text, '') = '' THEN '' ELSE regexp_replace(regexp_replace(s.text, '[ \\t\\r\\x0b\\x0c\\x{{a0}}]+(\\n|$)', '\\1', 'g') || chr(10), '([^\\n])\\n{{3,}}', '\\1' || chr(10) || chr(10) || chr(10), 'g') END AS text FROM d LEFT JOIN s USING (doc_id))
        SELECT doc_id, md5(text) AS text_md5, length(text)::INTEGER AS chars_after FROM w""",
    ),
    "loop_detector": (
        loop_detector,
        f"""WITH d AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {DOCS}),
        g AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS gram FROM d WHERE len(ws) >= 4) GROUP BY 1, 2) GROUP BY 1),
        p AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, piece, count(*) AS n FROM (SELECT doc_id, trim(unnest(list_transform(range(0, length(text) - 30, 10), lambda i: substr(text, i + 1, 30)))) AS piece FROM d) WHERE length(piece) >= 20 GROUP BY 1, 2) GROUP BY 1)
        SELECT doc_id, coalesce(g.n, 0)::INTEGER AS max_ngram, coalesce(p.n, 0)::INTEGER AS max_piece,
          length(text) >= 100 AND (coalesce(g.n, 0) > 20 OR coalesce(p.n, 0) > 15 OR (length(text) > 8000 AND NOT suffix(rtrim(text), '}}'))) AS looping
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN p USING (doc_id)""",
    ),
    "normal_lines": (
        normal_lines,
        f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1)::INTEGER - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {DOCS})), g AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS generic FROM l)
        SELECT doc_id, pos, generic, lower(trim(line)) AS email, regexp_replace(line, '[^0-9+]', '', 'g') AS phone,
          trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(lower(generic), ' '), lambda w: w NOT IN ({", ".join(map(quote, tx.SERVICE_STOPWORDS))})), ' '),
            '\\bsistemas\\b', 'sistema', 'g'), '\\bserviços\\b', 'serviço', 'g'), '\\bsoluções\\b', 'solução', 'g')) AS service,
          CASE WHEN length(line) > 40 THEN substr(line, 1, 40) || '... [truncated, total ' || length(line) || ' chars]' ELSE line END AS short, md5(lower(trim(line)) || ':25') AS cache_key FROM g""",
    ),
    "normal_page_urls": (
        normal_page_urls,
        "WITH b AS (SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS u FROM pages) SELECT page_id, CASE WHEN suffix(u, '/') AND length(u) > 9 THEN substr(u, 1, length(u) - 1) ELSE u END AS url FROM b",
    ),
    "display_names": (
        display_names,
        """SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 AND trim(p_name) <> '' THEN p_name WHEN p_partkey % 3 <> 0 AND trim(p_type) <> '' THEN substr(p_type, 1, 100)
        WHEN p_partkey % 5 <> 0 AND trim(string_split(p_brand, '.')[1]) <> '' THEN substr(string_split(p_brand, '.')[1], 1, 50) ELSE 'Empresa CNPJ ' || lpad(p_partkey::VARCHAR, 8, '0') END AS name FROM part""",
    ),
    "employee_ranges": (
        employee_ranges,
        "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || '-' || p_size * 2 ELSE p_size || '+' END AS span, CASE WHEN p_size % 3 = 0 THEN p_size END AS least, CASE WHEN p_size % 3 = 0 THEN p_size * 2 END AS most FROM part",
    ),
}
