"""Registered queries on whole nested profiles: normalised answers and their merge (J02, J07, M07, M11, M12, D02, AR9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import bundle as bd
from quarrymill.operators import normal as nm
from quarrymill.operators import relational as rl
from quarrymill.plans.facts import MORE, SUPPLIED
from quarrymill.session import table
from quarrymill.staging import spread, spread_tasks, staged, tasks_for

#: Answers as a model might give them, with scalars for lists, lists for objects and odd values in lists.
ANSWER = """concat(CASE WHEN k % 5 = 0 THEN '[' ELSE '' END,
  '{"identity": {"company_name": "', p_name, '", "tagline": "', p_type, '", "description": "', p_brand, ' makes ', p_type, '", "founding_year": ', 1990 + k % 30, '}, "classification": ', CASE WHEN k % 4 = 0 THEN '["x"]' ELSE concat('{"industry": "', p_brand, '"}') END,
  ', "team": {"key_roles": ', CASE k % 3 WHEN 0 THEN concat('"', p_type, ' "') WHEN 1 THEN concat('["', p_type, '", null, 5, " ", "', p_type, '"]') ELSE 'null' END,
  '}, "offerings": {"products": ["', p_name, '", "', p_brand, '", 7], "services": ', CASE WHEN k % 2 = 0 THEN concat('["', p_type, '"]') ELSE '"no list"' END,
  ', "product_categories": [{"category_name": "', p_brand, '", "items": ["', p_type, '", " ", 3]}, {"category_name": "", "items": []}, {"category_name": "Geral"}, "bad"], "service_details": [{"name": "', p_type, '", "description": "', p_name,
  '", "methodology": "as ', p_brand, '", "deliverables": ["', p_brand, '", ""]}]}, "reputation": {"certifications": [{"name": " ", "title": "', p_brand, '"}, "', p_type, '", null], "awards": "', p_brand,
  '", "case_studies": [{"challenge": "', p_name, '", "outcome": "', p_type, '"}, {}, "x"]}, "contact": {"emails": ', CASE WHEN k % 2 = 0 THEN concat('"m', k % 9, '@h.com"') ELSE '[]' END,
  ', "website_url": ["ftp://x", "http://', k % 6, '.com"], "linkedin_url": 5, "headquarters_address": ["', p_type, '", 1]}, "sources": ["u', k % 4, '"]}', CASE WHEN k % 5 = 0 THEN ', "x"]' ELSE '' END)"""


def answers(spark: SparkSession, directory: str) -> DataFrame:
    """Every part as an answer on its own; each thirteenth is no object."""
    return _parts(spark, directory).select("k", F.expr(f"CASE WHEN k % 13 = 0 THEN '[]' ELSE {ANSWER} END").alias("body"))


def _parts(spark: SparkSession, directory: str) -> DataFrame:
    """Parts, spread, since an answer is many times its row and is rewritten at some cost."""
    return spread(table(spark, directory, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_brand"))


def normal_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """Each part's answer as a profile, and that as the JSON that is stored."""
    found = nm.normal_profiles(answers(spark, directory), "body")
    return found.select("k", nm.completeness(found).alias("score"), F.md5(nm.profile_json(found)).alias("json_md5"))


def founding_years(spark: SparkSession, directory: str) -> DataFrame:
    """Founding years as answers tell them: numbers, numbers as text, and other text."""
    k = F.col("p_partkey")
    year = (1950 + k % 70).cast("string")
    told = F.when(k % 5 == 0, year).when(k % 5 == 1, F.concat(F.lit('" '), year, F.lit('"'))).when(k % 5 == 2, F.concat(F.lit('"desde '), year, F.lit('"'))).when(k % 5 == 3, F.concat(year, F.lit(".5"))).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"identity": {"founding_year": '), told, F.lit("}}"))
    found = nm.normal_profiles(spread(table(spark, directory, "part").select("p_partkey")).select("p_partkey", body.alias("body")), "body")
    return found.select("p_partkey", nm.founding_year(F.col("identity.founding_year")).alias("founding_year"))


def upserted_profile_json(spark: SparkSession, directory: str) -> DataFrame:
    """Profiles stored as JSON; answers of brands' later parts replace the earlier ones."""
    found = nm.normal_profiles(answers(spark, directory).where("k % 13 <> 0"), "body")
    # Written once: the filter and both sides would each rewrite the answers again.
    stored = staged(found.select(F.col("classification.industry").alias("key"), "k", nm.profile_json(found).alias("json")), "stored").where("key IS NOT NULL")
    old, new = (rl.latest_value(stored.where(f"k % 2 = {part}"), "key", ["k"]) for part in (0, 1))
    return rl.upsert(old, new, "key").select("key", "k", F.md5("json").alias("json_md5"))


def merged_bundles(spark: SparkSession, directory: str) -> DataFrame:
    """Suppliers' profiles, each merged from the answers for all parts that they deliver."""
    lines = table(spark, directory, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, directory, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_brand")
    n = max(spread_tasks(spark), tasks_for(lines))
    # A part's answer is rewritten once and not for each supplier of it, and travels to none of them.
    suppliers = lines.repartition(n, "l_partkey").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("companies"))
    shared = suppliers.join(part.repartition(n, "k"), F.col("l_partkey") == F.col("k")).select(F.monotonically_increasing_id().alias("id"), "companies", F.col("k").alias("chunk"), F.expr(ANSWER).alias("body"))
    partial = staged(nm.normal_profiles(shared, "body"), "answers")
    merged = bd.merged_profiles(partial)
    joined = lambda values: F.array_join(values, "|")
    services = F.transform("offerings.service_details", lambda s: F.concat_ws("#", s["name"], s["description"], s["methodology"], joined(s["deliverables"])))
    categories = F.transform("offerings.product_categories", lambda c: F.concat_ws("#", c["category_name"], joined(c["items"])))
    cases = F.transform("reputation.case_studies", lambda c: F.concat_ws("#", c["title"], c["challenge"], c["outcome"]))
    return merged.select(
        "company", "profiles", "identity.company_name", "identity.tagline", F.md5("identity.description").alias("description_md5"), "identity.founding_year", "classification.industry",
        joined("team.key_roles").alias("key_roles"), F.md5(joined("offerings.products")).alias("products_md5"), F.md5(joined("offerings.services")).alias("services_md5"), F.md5(joined(services)).alias("details_md5"),
        F.md5(joined(categories)).alias("categories_md5"), F.md5(joined("reputation.certifications")).alias("certifications_md5"), joined("reputation.awards").alias("awards"), F.md5(joined(cases)).alias("cases_md5"),
        joined("contact.emails").alias("emails"), "contact.website_url", "contact.linkedin_url", "contact.headquarters_address", joined("sources").alias("sources"),
    )


SCORE = (
    "(length(p_name) // 10 + length(p_type) // 10 + length(p_brand || ' makes ' || p_type) // 10 + CASE WHEN k % 4 = 0 THEN 0 ELSE length(p_brand) // 10 END + CASE WHEN k % 3 < 2 THEN 1 ELSE 0 END + "
    "len(list_distinct([p_name, p_brand])) + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + 2 + 1 + len(list_distinct([p_brand, p_type])) + 1 + 1 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + length('http://' || k % 6 || '.com') // 10 + length(p_type) // 10 + 1)::BIGINT"
)
EMPTY_JSON = (
    '{"identity":{"company_name":null,"cnpj":null,"tagline":null,"description":null,"founding_year":null,"employee_count_range":null},"classification":{"industry":null,"business_model":null,"target_audience":null,"geographic_coverage":null},'
    '"team":{"size_range":null,"key_roles":[],"team_certifications":[]},"offerings":{"products":[],"services":[],"engagement_models":[],"key_differentiators":[],"product_categories":[],"service_details":[]},'
    '"reputation":{"certifications":[],"awards":[],"partnerships":[],"client_list":[],"case_studies":[]},"contact":{"emails":[],"phones":[],"locations":[],"headquarters_address":null,"website_url":null,"linkedin_url":null},"sources":[]}'
)
JSON = """to_json({'identity': {'company_name': p_name, 'cnpj': NULL, 'tagline': p_type, 'description': p_brand || ' makes ' || p_type, 'founding_year': (1990 + k % 30)::VARCHAR, 'employee_count_range': NULL},
  'classification': {'industry': CASE WHEN k % 4 > 0 THEN p_brand END, 'business_model': NULL, 'target_audience': NULL, 'geographic_coverage': NULL},
  'team': {'size_range': NULL, 'key_roles': CASE WHEN k % 3 < 2 THEN [p_type] ELSE [] END, 'team_certifications': []},
  'offerings': {'products': [p_name, p_brand], 'services': CASE WHEN k % 2 = 0 THEN [p_type] ELSE [] END, 'engagement_models': [], 'key_differentiators': [],
    'product_categories': [{'category_name': p_brand, 'items': [p_type]}, {'category_name': 'Geral', 'items': []}],
    'service_details': [{'name': p_type, 'description': p_name, 'methodology': 'as ' || p_brand, 'ideal_client_profile': NULL, 'deliverables': [p_brand]}]},
  'reputation': {'certifications': [p_brand, p_type], 'awards': [p_brand], 'partnerships': [], 'client_list': [],
    'case_studies': [{'title': 'Desafio: ' || p_name[:50] || '...', 'client_name': NULL, 'industry': NULL, 'challenge': p_name, 'solution': NULL, 'outcome': p_type}]},
  'contact': {'emails': CASE WHEN k % 2 = 0 THEN ['m' || k % 9 || '@h.com'] ELSE [] END, 'phones': [], 'locations': [], 'headquarters_address': p_type, 'website_url': 'http://' || k % 6 || '.com', 'linkedin_url': NULL},
  'sources': ['u' || k % 4]})::VARCHAR"""
PARTS = "(SELECT p_partkey AS k, p_name, p_type, p_brand FROM part)"
FOLD = "list_reduce(list({0} ORDER BY pl), lambda a, x: " + MORE.format(a="a", b="x") + ")"
LONGEST = "min_by({0}, (-length({0}), pl))"
UNION = "(SELECT company, string_agg(v, '|' ORDER BY s) AS {name} FROM (SELECT company, v, min((pl, i)) AS s FROM (SELECT company, pl, unnest({values}) AS v, unnest(range(len({values}))) AS i FROM p) GROUP BY 1, 2) GROUP BY 1)"

QUERIES = {
    "normal_profiles": (
        normal_profiles,
        f"SELECT k, CASE WHEN k % 13 = 0 THEN 0 ELSE {SCORE} END AS score, md5(CASE WHEN k % 13 = 0 THEN '{EMPTY_JSON}' ELSE {JSON} END) AS json_md5 FROM {PARTS}",
    ),
    "founding_years": (founding_years, "SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN (1950 + p_partkey % 70)::INTEGER END AS founding_year FROM part"),
    "upserted_profile_json": (
        upserted_profile_json,
        f"""SELECT p_brand AS key, max_by(k, (k % 2, k)) AS k, md5(max_by({JSON}, (k % 2, k))) AS json_md5 FROM {PARTS} WHERE k % 13 <> 0 AND k % 4 <> 0 GROUP BY p_brand""",
    ),
    "merged_bundles": (
        merged_bundles,
        f"""WITH r AS (SELECT company, chunk AS k, p_name, p_type, p_brand FROM {SUPPLIED}), s AS (SELECT *, {SCORE} AS score FROM r),
        b AS (SELECT company, arg_max(k, (score, -k)) AS base FROM s GROUP BY 1), p AS (SELECT s.*, (k <> base, k) AS pl, p_brand || ' makes ' || p_type AS told, (1990 + k % 30)::VARCHAR AS y, 'http://' || k % 6 || '.com' AS web FROM s JOIN b USING (company)),
        one AS (SELECT company, count(*) AS profiles, {LONGEST.format("p_name")} AS company_name, {FOLD.format("p_type")} AS tagline, md5({FOLD.format("told")}) AS description_md5, {LONGEST.format("y")} AS founding_year,
          min_by(p_brand, (-length(p_brand), pl)) FILTER (k % 4 > 0) AS industry, coalesce(min_by(p_type, pl) FILTER (k % 3 < 2), '') AS key_roles, coalesce(min_by('m' || k % 9 || '@h.com', pl) FILTER (k % 2 = 0), '') AS emails,
          {LONGEST.format("web")} AS website_url, {LONGEST.format("p_type")} AS headquarters_address FROM p GROUP BY 1),
        d AS (SELECT company, p_type, min(pl) AS s, {FOLD.format("p_name")} AS a, {FOLD.format("'as ' || p_brand")} AS m FROM p GROUP BY 1, 2),
        dd AS (SELECT company, p_type, string_agg(p_brand, '|' ORDER BY s) AS l FROM (SELECT company, p_type, p_brand, min(pl) AS s FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2),
        details AS (SELECT company, md5(string_agg(p_type || '#' || a || '#' || m || '#' || l, '|' ORDER BY s)) AS details_md5 FROM d JOIN dd USING (company, p_type) GROUP BY 1),
        c AS (SELECT company, p_brand, min(s) AS s, string_agg(p_type, '|' ORDER BY s) AS l FROM (SELECT company, p_brand, p_type, min(pl) AS s FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2),
        cats AS (SELECT company, md5(string_agg(p_brand || '#' || l, '|' ORDER BY s)) AS categories_md5 FROM c GROUP BY 1),
        cs AS (SELECT company, 'Desafio: ' || p_name[:50] || '...' AS t, min(pl) AS s, {LONGEST.format("p_name")} AS a, {LONGEST.format("p_type")} AS o FROM p GROUP BY 1, 2),
        cases AS (SELECT company, md5(string_agg(t || '#' || a || '#' || o, '|' ORDER BY s)) AS cases_md5 FROM cs GROUP BY 1),
        pr AS {UNION.format(name="products", values="[p_name, p_brand]")}, sv AS {UNION.format(name="services", values="(CASE WHEN k % 2 = 0 THEN [p_type] ELSE [] END)")},
        ce AS {UNION.format(name="certifications", values="[p_brand, p_type]")}, aw AS {UNION.format(name="awards", values="[p_brand]")}, so AS {UNION.format(name="sources", values="['u' || k % 4]")}
        SELECT one.*, NULL::VARCHAR AS linkedin_url, md5(products) AS products_md5, md5(coalesce(services, '')) AS services_md5, details_md5, categories_md5, md5(certifications) AS certifications_md5, awards, cases_md5, sources
        FROM one JOIN details USING (company) JOIN cats USING (company) JOIN cases USING (company) JOIN pr USING (company) LEFT JOIN sv USING (company) JOIN ce USING (company) JOIN aw USING (company) JOIN so USING (company)""",
    ),
}
