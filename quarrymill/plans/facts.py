"""Registered queries on facts and profiles (M01-M13, P13, P17, A21, A22, AR1-AR5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.operators import facts as ft
from quarrymill.operators import profiles as pf
from quarrymill.session import table
from quarrymill.staging import tasks_for

MARKS = (" cliente fiel", " ISO 9001", " award", " parceiro", " nada")


def product_or_service(spark: SparkSession, directory: str) -> DataFrame:
    part = table(spark, directory, "part")
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))))
    rows = part.select("p_partkey", tx.collapse_spaces(value).alias("value"))
    kind = ft.offering_field(F.col("value"))
    return rows.select("p_partkey", kind.alias("kind"), F.when(kind == "services", tx.service_label(F.col("value"))).otherwise(F.col("value")).alias("label"))


def contact_facts(spark: SparkSession, directory: str) -> DataFrame:
    """Words of documents with an at sign or four digits, as contact facts of their source."""
    docs = table(spark, directory, "documents").select(F.coalesce("source", F.lit("")).alias("company"), F.col("doc_id").alias("chunk"), F.posexplode(F.split("text", r"[ \n]+")).alias("pos", "value"))
    some = docs.where(F.contains("value", F.lit("@")) | F.col("value").rlike("[0-9]{4}"))
    return some.select("company", "chunk", "pos", F.lit("contact").alias("section"), "value", F.lit("").alias("quote"))


def merged_contacts(spark: SparkSession, directory: str) -> DataFrame:
    return ft.merged_lists(ft.routed(contact_facts(spark, directory))).select("company", "field", "rank", "value", "evidence")


def supplied_parts(spark: SparkSession, directory: str) -> DataFrame:
    """What each supplier delivers: company, chunk (the part), name, type, brand; tasks hold a bounded number of lines."""
    lines = table(spark, directory, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, directory, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    n = tasks_for(lines)
    pairs = lines.repartition(n, "l_partkey").distinct()
    joined = pairs.join(part.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_suppkey").alias("company"), F.col("l_partkey").alias("chunk"), "p_name", "p_type", "p_brand")


def merged_offerings(spark: SparkSession, directory: str) -> DataFrame:
    rows = supplied_parts(spark, directory)
    facts = rows.select("company", "chunk", F.posexplode(F.array("p_type", "p_brand")).alias("pos", "value"), F.lit("offerings").alias("section"), F.lit("").alias("quote"))
    return ft.merged_lists(ft.routed(facts)).select("company", "field", "rank", "value", "evidence")


def merged_reputation(spark: SparkSession, directory: str) -> DataFrame:
    rows = supplied_parts(spark, directory)
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("chunk") % len(MARKS) + 1).cast("int"))
    facts = rows.select("company", "chunk", F.lit(0).alias("pos"), F.lit("reputation").alias("section"), F.col("p_name").alias("value"), F.concat("p_type", mark).alias("quote"))
    return ft.merged_lists(ft.routed(facts)).select("company", "field", "rank", "value", "evidence")


def merged_identity(spark: SparkSession, directory: str) -> DataFrame:
    rows = supplied_parts(spark, directory)
    value = F.when(F.col("chunk") % 5 == 0, F.concat("p_name", F.lit(" LTDA"))).when(F.col("chunk") % 5 == 1, F.concat(F.lit("desde "), "p_brand")).when(F.col("chunk") % 7 == 2, F.concat(F.lit("CNPJ "), "p_name")).otherwise(F.col("p_type"))
    facts = rows.select("company", "chunk", F.lit(0).alias("pos"), F.lit("identity").alias("section"), value.alias("value"), F.lit("").alias("quote"))
    return ft.merged_identity(ft.routed(facts))


def _profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as partial profiles of customers."""
    given = table(spark, directory, "lineitem")
    n = tasks_for(given)  # lists are widened again after the join, so tasks are bounded by lines
    lines = given.select("l_orderkey", "l_partkey", "l_suppkey").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")))).alias("products"),
        F.array_sort(F.collect_set(F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")))).alias("services"),
    )
    orders = table(spark, directory, "orders").repartition(n, "o_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("company"),
        F.col("o_orderkey").alias("chunk"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("tagline"),
        F.repeat(F.concat(F.col("o_orderpriority"), F.lit(" "), "o_orderstatus", F.lit(" ")), F.lit(3)).alias("description"),
        "products",
        "services",
        F.array().cast("array<string>").alias("emails"),
        F.array(F.concat(F.lit("u"), (F.col("o_orderkey") % 4).cast("string"))).alias("sources"),
    )


def profile_scores(spark: SparkSession, directory: str) -> DataFrame:
    return pf.scored(_profiles(spark, directory)).select("company", "chunk", "score")


def base_profiles(spark: SparkSession, directory: str) -> DataFrame:
    return pf.base_profiles(_profiles(spark, directory))


def profile_lists(spark: SparkSession, directory: str) -> DataFrame:
    merged = pf.merged_lists(_profiles(spark, directory))
    return merged.select("company", *[F.array_join(c, ",").alias(c) for c in pf.LISTS])


def merged_profiles(spark: SparkSession, directory: str) -> DataFrame:
    merged = pf.merge_profiles(_profiles(spark, directory))
    return merged.select("company", *pf.TEXTS, *[F.size(c).alias(f"n_{c}") for c in pf.LISTS])


def complementary_texts(spark: SparkSession, directory: str) -> DataFrame:
    part = table(spark, directory, "part")
    other = part.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("other"))
    both = part.join(other, F.col("p_partkey") + 1 == F.col("k"))
    return both.select("p_partkey", pf.complementary(F.concat_ws(" ", "p_name", "p_type"), F.col("other")).alias("complementary"))


def fill_rates(spark: SparkSession, directory: str) -> DataFrame:
    rows = _profiles(spark, directory)
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return rows.groupBy("company").agg(
        F.round(F.avg(pf.fill_rate([filled("products"), filled("services"), filled("emails"), filled("sources")])), 4).alias("fill"),
        F.count_if(pf.is_empty_profile([F.col(t) for t in pf.TEXTS], [F.col(x) for x in pf.LISTS])).alias("empty"),
        F.sum(F.size("products")).alias("items"),
    )


def named_categories(spark: SparkSession, directory: str) -> DataFrame:
    part = table(spark, directory, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "Outros ").when(F.col("p_partkey") % 4 == 1, " ").otherwise(F.col("p_brand")).alias("category"))
    return pf.named_categories(part, "category")


SPACED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
LABEL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(lower({0}), ' '), lambda w: w NOT IN ('de', 'da', 'do', 'das', 'dos')), ' '), "
    "'\\bsistemas\\b', 'sistema', 'g'), '\\bserviços\\b', 'serviço', 'g'), '\\bsoluções\\b', 'solução', 'g'))"
)
PRODUCT = "({0} <> '' AND (regexp_matches({0}, '[A-Za-z].*[0-9]|[0-9].*[A-Za-z]') OR regexp_matches({0}, '(?i)\\b[0-9]+\\s?(mm|cm|m|kg|g|gb|tb|v|hz|w|l|ml)\\b') OR regexp_matches({0}, '(?i)\\b(modelo|código|sku|ref\\.?|reference)\\b')))"
SUPPLIED = "(SELECT DISTINCT l_suppkey AS company, l_partkey AS chunk, p_name, p_type, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"
MERGED = """, one AS (SELECT company, field, {key} AS key, min_by(value, (chunk, pos)) AS value, min((chunk, pos)) AS place, least(count(*), 20) AS evidence FROM r WHERE value <> '' GROUP BY 1, 2, 3),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY company, field ORDER BY place, key) AS INTEGER) AS rank FROM one)
SELECT company, field, rank, value, evidence FROM ranked WHERE rank <= CASE WHEN field IN ('certifications', 'awards', 'partnerships') THEN 50 ELSE 80 END"""
PROFILES = """p AS (SELECT o_custkey AS company, o_orderkey AS chunk, 'Customer ' || o_custkey AS name, o_orderpriority AS tagline, repeat(o_orderpriority || ' ' || o_orderstatus || ' ', 3) AS description, products, services,
  ['u' || (o_orderkey % 4)] AS sources FROM orders JOIN (SELECT l_orderkey, list(DISTINCT 'p' || (l_partkey % 50)) AS products, list(DISTINCT 's' || (l_suppkey % 7)) AS services FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
s AS (SELECT *, CAST(length(name) // 10 + length(tagline) // 10 + length(description) // 10 + len(products) + len(services) + 1 AS BIGINT) AS score FROM p)"""
WORDS = "list_distinct(list_filter(string_split_regex(lower(trim({0})), '\\s+'), lambda w: w <> ''))"
WORDS_OF = "list_distinct(list_filter(string_split_regex(lower(trim({0})), '\\s+'), lambda w: w <> ''))"
MORE = (
    "CASE WHEN NOT contains(lower(trim({a})), lower(trim({b}))) AND NOT contains(lower(trim({b})), lower(trim({a}))) "
    + f"AND len(list_intersect({WORDS_OF.format('{a}')}, {WORDS_OF.format('{b}')})) / greatest(len({WORDS_OF.format('{a}')}), len({WORDS_OF.format('{b}')})) < 0.3 "
    + "THEN trim({a}) || '. ' || trim({b}) WHEN length({b}) > length({a}) THEN {b} ELSE {a} END"
)

QUERIES = {
    "product_or_service": (
        product_or_service,
        f"""WITH v AS (SELECT p_partkey, {SPACED.format("CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_brand ELSE p_name END")} AS value FROM part)
        SELECT p_partkey, CASE WHEN {PRODUCT.format("value")} THEN 'products' ELSE 'services' END AS kind, CASE WHEN {PRODUCT.format("value")} THEN value ELSE {LABEL.format("value")} END AS label FROM v""",
    ),
    "merged_contacts": (
        merged_contacts,
        """WITH w AS (SELECT coalesce(source, '') AS company, doc_id AS chunk, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS value FROM (SELECT *, string_split_regex(text, '[ \\n]+') AS ws FROM documents)),
        f AS (SELECT company, chunk, pos, trim(value) AS value FROM w WHERE contains(value, '@') OR regexp_matches(value, '[0-9]{4}')),
        t AS (SELECT *, CASE WHEN contains(value, '@') THEN 'emails' WHEN regexp_matches(value, '[0-9]{8,}') THEN 'phones' WHEN regexp_matches(value, '^https?://') THEN 'website_url' WHEN length(value) >= 5 THEN 'locations' END AS field FROM f),
        r AS (SELECT company, chunk, pos, field, CASE field WHEN 'emails' THEN lower(value) WHEN 'phones' THEN regexp_replace(value, '[^0-9+]', '', 'g') ELSE value END AS value FROM t WHERE field IS NOT NULL)"""
        + MERGED.format(key="CASE WHEN field = 'locations' THEN lower(value) ELSE value END"),
    ),
    "merged_offerings": (
        merged_offerings,
        f"""WITH f AS (SELECT company, chunk, 0 AS pos, p_type AS value FROM {SUPPLIED} UNION ALL SELECT company, chunk, 1, p_brand FROM {SUPPLIED}), v AS (SELECT company, chunk, pos, {SPACED.format("value")} AS value FROM f),
        r AS (SELECT company, chunk, pos, CASE WHEN {PRODUCT.format("value")} THEN 'products' ELSE 'services' END AS field, CASE WHEN {PRODUCT.format("value")} THEN value ELSE {LABEL.format("value")} END AS value FROM v)"""
        + MERGED.format(key="lower(value)"),
    ),
    "merged_reputation": (
        merged_reputation,
        f"""WITH f AS (SELECT company, chunk, 0 AS pos, {SPACED.format("p_name")} AS value, lower(p_type || [' cliente fiel', ' ISO 9001', ' award', ' parceiro', ' nada'][chunk % 5 + 1]) AS q FROM {SUPPLIED}),
        r AS (SELECT company, chunk, pos, value, CASE {" ".join(f"WHEN regexp_matches(q, '{'|'.join(words)}') THEN '{name}'" for name, words in ft.QUOTE_WORDS)} END AS field FROM f)"""
        + MERGED.format(key="lower(value)").replace("WHERE value <> ''", "WHERE value <> '' AND field IS NOT NULL"),
    ),
    "merged_identity": (
        merged_identity,
        f"""WITH f AS (SELECT company, chunk, {SPACED.format("CASE WHEN chunk % 5 = 0 THEN p_name || ' LTDA' WHEN chunk % 5 = 1 THEN 'desde ' || p_brand WHEN chunk % 7 = 2 THEN 'CNPJ ' || p_name ELSE p_type END")} AS value FROM {SUPPLIED}),
        t AS (SELECT *, CASE WHEN contains(lower(value), 'cnpj') OR regexp_matches(value, '[0-9]{{11,14}}') THEN 'cnpj' WHEN regexp_matches(lower(value), 'ltda|s[.]a|sa |me |eireli') THEN 'company_name' WHEN regexp_matches(lower(value), 'fundada|desde') THEN 'founding_year' ELSE 'description' END AS field FROM f)
        SELECT company, min_by(value, chunk) FILTER (field = 'cnpj') AS cnpj, min_by(value, chunk) FILTER (field = 'company_name') AS company_name, min_by(value, chunk) FILTER (field = 'founding_year') AS founding_year,
          min_by(value, (length(value), chunk)) FILTER (field = 'description') AS description FROM t GROUP BY company""",
    ),
    "profile_scores": (profile_scores, f"WITH {PROFILES} SELECT company, chunk, score FROM s"),
    "base_profiles": (base_profiles, f"WITH {PROFILES} SELECT company, arg_max(chunk, (score, -chunk)) AS chunk, max(score) AS score FROM s GROUP BY company"),
    "profile_lists": (
        profile_lists,
        f"""WITH {PROFILES}, j AS (SELECT company, list_sort(list_distinct(flatten(list(products)))) AS a, list_sort(list_distinct(flatten(list(services)))) AS b, list_sort(list_distinct(flatten(list(sources)))) AS c FROM p GROUP BY 1)
        SELECT company, array_to_string(a, ',') AS products, array_to_string(b, ',') AS services, '' AS emails, array_to_string(c, ',') AS sources FROM j""",
    ),
    "merged_profiles": (
        merged_profiles,
        f"""WITH {PROFILES}, b AS (SELECT company, arg_max(chunk, (score, -chunk)) AS base FROM s GROUP BY 1),
        o AS (SELECT s.company, list({{'t': tagline, 'd': description}} ORDER BY chunk <> base, chunk) AS l, list_distinct(flatten(list(products))) AS a, list_distinct(flatten(list(services))) AS b, list_distinct(flatten(list(sources))) AS c FROM s JOIN b USING (company) GROUP BY 1),
        f AS (SELECT *, list_reduce(l, lambda acc, x: {{'t': {MORE.format(a="acc.t", b="x.t")}, 'd': {MORE.format(a="acc.d", b="x.d")}}}) AS r FROM o)
        SELECT company, 'Customer ' || company AS name, r.t AS tagline, r.d AS description, len(a)::INTEGER AS n_products, len(b)::INTEGER AS n_services, 0 AS n_emails, len(c)::INTEGER AS n_sources FROM f""",
    ),
    "complementary_texts": (
        complementary_texts,
        f"""WITH b AS (SELECT a.p_partkey, a.p_name || ' ' || a.p_type AS x, b.p_type AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
        SELECT p_partkey, trim(x) <> '' AND trim(y) <> '' AND NOT contains(lower(trim(x)), lower(trim(y))) AND NOT contains(lower(trim(y)), lower(trim(x)))
          AND len(list_intersect({WORDS.format("x")}, {WORDS.format("y")})) / greatest(len({WORDS.format("x")}), len({WORDS.format("y")})) < 0.3 AS complementary FROM b""",
    ),
    "fill_rates": (fill_rates, f"WITH {PROFILES} SELECT company, 0.75 AS fill, 0 AS empty, CAST(sum(len(products)) AS BIGINT) AS items FROM p GROUP BY 1"),
    "named_categories": (
        named_categories,
        "SELECT * FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Outros ' WHEN 1 THEN ' ' ELSE p_brand END AS category FROM part) WHERE trim(category) <> '' AND lower(trim(category)) <> 'outros'",
    ),
}
