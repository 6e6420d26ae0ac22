"""Registered queries on nested profile sections (M12, M13, AR1, AR4, AR7, A21, K13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import profiles as pf
from quarrymill.operators import sections as sc
from quarrymill.plans.facts import MORE, SUPPLIED, supplied_parts
from quarrymill.session import table

# Entries from which a list counts as full.
CAPS = {"emails": 10, "phones": 10, "locations": 25, "products": 60, "services": 60, "categories": 40, "certifications": 30, "awards": 20, "partnerships": 50, "client_list": 80}


def _supplied(spark: SparkSession, directory: str) -> DataFrame:
    """What each supplier delivers: company, place, name, type, brand."""
    return supplied_parts(spark, directory).withColumnRenamed("chunk", "place")


def merged_categories(spark: SparkSession, directory: str) -> DataFrame:
    """Brands as categories with the parts' names as items; some names are blank or say nothing."""
    odd = F.col("place") % 10
    name = F.when(odd == 0, "Outros ").when(odd == 1, " ").otherwise(F.col("p_brand"))
    entries = _supplied(spark, directory).select("company", "place", name.alias("category_name"), F.array(F.lit(" "), F.concat(F.lit(" "), "p_type"), "p_name").alias("items"))
    merged = sc.merged_entries(pf.named_categories(entries, "category_name"), "category_name", "place", ["items"], [], [])
    return merged.select("company", "category_name", F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("items_md5"))


def merged_services(spark: SparkSession, directory: str) -> DataFrame:
    """Types as services described by their parts."""
    entries = _supplied(spark, directory).select(
        "company", "place", F.col("p_type").alias("name"), F.col("p_name").alias("description"), F.concat(F.lit("as "), "p_brand").alias("methodology"),
        F.when(F.col("place") % 3 != 0, F.col("p_brand")).alias("ideal_client_profile"), F.array("p_brand", F.lit("")).alias("deliverables"),
    )
    merged = sc.merged_entries(entries, "name", "place", ["deliverables"], ["ideal_client_profile"], ["description", "methodology"])
    return merged.withColumn("deliverables", F.array_join("deliverables", "|")).drop("seen")


def merged_cases(spark: SparkSession, directory: str) -> DataFrame:
    """Brands as case studies told by their parts."""
    entries = _supplied(spark, directory).select(
        "company", "place", F.col("p_brand").alias("title"), F.col("p_name").alias("challenge"), F.when(F.col("place") % 2 == 0, F.col("p_type")).alias("outcome"), F.concat_ws(" ", "p_type", "p_name").alias("client_name")
    )
    return sc.merged_entries(entries, "title", "place", [], ["challenge", "outcome", "client_name"], []).drop("seen")


def section_fill_rates(spark: SparkSession, directory: str) -> DataFrame:
    """Customers as profiles: the share of each section's fields that their orders fill, and of lists that are full."""
    orders = table(spark, directory, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("priorities"), F.countDistinct("o_orderstatus").alias("statuses"), F.count_if(F.col("o_totalprice") > 200000).alias("large")
    )
    rows = table(spark, directory, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["orders", "priorities", "statuses", "large"])
    n = {name: F.col(name) for name in ("orders", "priorities", "statuses", "large")}
    sections = {
        "identity": [F.col("c_name") != "", F.col("c_acctbal") > 0, F.col("c_mktsegment") != "", n["orders"] > 0, n["large"] > 0, F.lit(False)],
        "contact": [n["orders"] > 5, n["priorities"] > 3, n["statuses"] > 1, F.col("c_nationkey") > 10, F.lit(True), n["large"] > 2],
        "offerings": [n["orders"] > 0, n["priorities"] > 0, n["statuses"] > 2, n["large"] > 1, F.col("c_acctbal") > 5000],
        "reputation": [n["large"] > 3, n["large"] > 5, n["priorities"] > 4, n["orders"] > 15, F.col("c_acctbal") < 0],
    }
    sizes = dict(zip(CAPS, [n["orders"], n["large"], n["priorities"] * 6, n["orders"] * 4, n["orders"] * 3, n["statuses"] * 15, n["large"] * 10, n["priorities"] * 4, n["orders"] * 5, n["large"] * 20], strict=True))
    return rows.select("c_custkey", *[sc.section_fill(filled).alias(name) for name, filled in sections.items()], sc.cap_hits(sizes, CAPS).alias("cap_hit_rate"))


def comma_lists(spark: SparkSession, directory: str) -> DataFrame:
    """A comma list of each page's address parts, back as a list without blanks, in first-seen order."""
    listed = F.regexp_replace("url", "[/?&#=.]", " , ")
    items = F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return table(spark, directory, "pages").select("page_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


def provider_flags(spark: SparkSession, directory: str) -> DataFrame:
    """Whether each user's provider is enabled: by the map, or by default where the map is silent."""
    flags = F.from_json(F.lit('{"0": false, "3": true, "4": false}'), "map<string, boolean>")
    events = table(spark, directory, "events").select("user_id", (F.col("user_id") % 5).cast("string").alias("provider")).distinct()
    return events.select("user_id", "provider", F.coalesce(flags[F.col("provider")], F.col("provider") != "1").alias("enabled"))


ENTRIES = f"(SELECT company, chunk AS place, p_name, p_type, p_brand FROM {SUPPLIED})"
FOLD = "list_reduce(list({0} ORDER BY place), lambda a, x: " + MORE.format(a="a", b="x") + ")"
LONGEST = "arg_max({0}, (length({0}), -place)) FILTER (trim({0}) <> '') AS {0}"


def _share(*tests: str) -> str:
    return "round((" + " + ".join(f"({t})::INT" for t in tests) + f") / {len(tests)}, 4)"


QUERIES = {
    "merged_categories": (
        merged_categories,
        f"""WITH e AS (SELECT company, place, CASE place % 10 WHEN 0 THEN 'Outros ' WHEN 1 THEN ' ' ELSE p_brand END AS category_name, p_name, p_type FROM {ENTRIES}),
        i AS (SELECT company, category_name, value, min((place, pos)) AS seen FROM (SELECT company, category_name, place, 1 AS pos, trim(p_type) AS value FROM e UNION ALL SELECT company, category_name, place, 2, trim(p_name) FROM e) WHERE place % 10 > 1 AND value <> '' GROUP BY 1, 2, 3)
        SELECT company, category_name, count(*)::INTEGER AS n_items, md5(string_agg(value, '|' ORDER BY seen)) AS items_md5 FROM i GROUP BY 1, 2""",
    ),
    "merged_services": (
        merged_services,
        f"""WITH e AS (SELECT company, place, p_type AS name, p_name AS description, 'as ' || p_brand AS methodology, CASE WHEN place % 3 <> 0 THEN p_brand END AS ideal_client_profile, p_brand FROM {ENTRIES}),
        d AS (SELECT company, name, string_agg(p_brand, '|' ORDER BY seen) AS deliverables FROM (SELECT company, name, p_brand, min(place) AS seen FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
        t AS (SELECT company, name, {LONGEST.format("ideal_client_profile")}, {FOLD.format("description")} AS description, {FOLD.format("methodology")} AS methodology FROM e GROUP BY 1, 2)
        SELECT * FROM t JOIN d USING (company, name)""",
    ),
    "merged_cases": (
        merged_cases,
        f"""WITH e AS (SELECT company, place, p_brand AS title, p_name AS challenge, CASE WHEN place % 2 = 0 THEN p_type END AS outcome, p_type || ' ' || p_name AS client_name FROM {ENTRIES})
        SELECT company, title, {LONGEST.format("challenge")}, {LONGEST.format("outcome")}, {LONGEST.format("client_name")} FROM e GROUP BY 1, 2""",
    ),
    "section_fill_rates": (
        section_fill_rates,
        f"""WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderstatus) AS s, count(*) FILTER (o_totalprice > 200000) AS l FROM orders GROUP BY 1),
        r AS (SELECT c_custkey, c_acctbal AS b, c_nationkey AS k, c_name, c_mktsegment, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(s, 0) AS s, coalesce(l, 0) AS l FROM customer LEFT JOIN o ON o_custkey = c_custkey)
        SELECT c_custkey, {_share("c_name <> ''", "b > 0", "c_mktsegment <> ''", "n > 0", "l > 0", "false")} AS identity, {_share("n > 5", "p > 3", "s > 1", "k > 10", "true", "l > 2")} AS contact,
          {_share("n > 0", "p > 0", "s > 2", "l > 1", "b > 5000")} AS offerings, {_share("l > 3", "l > 5", "p > 4", "n > 15", "b < 0")} AS reputation,
          {_share("n >= 10", "l >= 10", "p * 6 >= 25", "n * 4 >= 60", "n * 3 >= 60", "s * 15 >= 40", "l * 10 >= 30", "p * 4 >= 20", "n * 5 >= 50", "l * 20 >= 80")} AS cap_hit_rate FROM r""",
    ),
    "comma_lists": (
        comma_lists,
        """WITH x AS (SELECT page_id, generate_subscripts(l, 1) AS pos, trim(unnest(l)) AS item FROM (SELECT page_id, string_split(regexp_replace(url, '[/?&#=.]', ',', 'g'), ',') AS l FROM pages)),
        f AS (SELECT page_id, item, min(pos) AS pos FROM x WHERE item <> '' GROUP BY 1, 2) SELECT page_id, count(*)::INTEGER AS n, string_agg(item, '|' ORDER BY pos) AS items FROM f GROUP BY 1""",
    ),
    "provider_flags": (provider_flags, "SELECT DISTINCT user_id, (user_id % 5)::VARCHAR AS provider, user_id % 5 IN (2, 3) AS enabled FROM events"),
}
