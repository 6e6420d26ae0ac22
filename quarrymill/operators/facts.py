"""Facts of companies: routing by rule, normal forms, first occurrences and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as tx
from quarrymill.functions.rules import contains_any, ladder

# Words that route a fact.
COMPANY_WORDS = ("ltda", "s.a", "sa ", "me ", "eireli")
FOUNDING_WORDS = ("fundada", "desde")
QUOTE_WORDS = (
    ("client_list", ("cliente", "clientes", "quem confia", "cases", "nossos clientes")),
    ("certifications", ("certificação", "iso", "anvisa", "inmetro")),
    ("awards", ("prêmio", "premiação", "award")),
    ("partnerships", ("parceria", "parceiro", "partner")),
)
# Entries kept of each list, and evidence kept of each field.
LIST_CAP, LIST_CAPS, EVIDENCE_CAP = 80, {"certifications": 50, "awards": 50, "partnerships": 50}, 20


def is_likely_product(text: Column) -> Column:
    """Letters mixed with digits, a number with a unit, or a word that names a model or code."""
    mixed = text.rlike(r"[A-Za-z].*\d|\d.*[A-Za-z]")
    unit = text.rlike(r"(?iU)\b\d+\s?(mm|cm|m|kg|g|gb|tb|v|hz|w|l|ml)\b")
    word = text.rlike(r"(?iU)\b(modelo|código|sku|ref\.?|reference)\b")
    return (text != "") & (mixed | unit | word)


def identity_field(value: Column) -> Column:
    low = F.lower(value)
    steps = [
        (F.contains(low, F.lit("cnpj")) | low.rlike(r"[0-9]{11,14}"), "cnpj"),
        (contains_any(low, COMPANY_WORDS), "company_name"),
        (contains_any(low, FOUNDING_WORDS), "founding_year"),
    ]
    return ladder(value, steps, "description")


def contact_field(value: Column) -> Column:
    """emails, phones, website_url or locations; null for what is too short to be a place."""
    steps = [(F.contains(value, F.lit("@")), "emails"), (value.rlike(r"[0-9]{8,}"), "phones"), (value.rlike("^https?://"), "website_url")]
    return F.nullif(ladder(value, [*steps, (F.char_length(value) >= 5, "locations")], ""), F.lit(""))


def offering_field(value: Column) -> Column:
    return F.when(is_likely_product(value), "products").otherwise("services")


def reputation_field(quote: Column) -> Column:
    """By words of the quote; null for none."""
    return F.nullif(ladder(quote, [(contains_any(F.lower(quote), words), name) for name, words in QUOTE_WORDS], ""), F.lit(""))


def routed(facts: DataFrame) -> DataFrame:
    """Facts (company, chunk, pos, section, value, quote) with field and the normal value of it.

    Blank values and values of no field go. Chunks without any fact simply have no rows.
    """
    clean = facts.withColumn("value", tx.collapse_spaces(F.col("value"))).where(F.col("value") != "")
    value, quote = F.col("value"), F.coalesce("quote", F.lit(""))
    field = (
        F.when(F.col("section") == "identity", identity_field(value))
        .when(F.col("section") == "contact", contact_field(value))
        .when(F.col("section") == "offerings", offering_field(value))
        .when(F.col("section") == "reputation", reputation_field(quote))
    )
    found = clean.withColumn("field", field).where(F.col("field").isNotNull())
    normal = (
        F.when(F.col("field") == "emails", tx.normal_email(value))
        .when(F.col("field") == "phones", tx.normal_phone(value))
        .when(F.col("field") == "website_url", tx.normal_url(value))
        .when(F.col("field") == "services", tx.service_label(value))
        .otherwise(value)
    )
    return found.withColumn("value", normal).where(F.col("value") != "")


def merged_lists(facts: DataFrame) -> DataFrame:
    """company, section, field, rank (from 1), value, evidence of routed facts.

    Values equal but for case are one, as first seen by (chunk, pos); each field keeps its first
    80, or 50 for some of reputation. Evidence counts the places of a value, at most 20. Equal
    values meet before the shuffle, so a company with very many facts is no heavier than its
    distinct values.
    """
    key = F.when(F.col("field").isin("emails", "phones", "website_url"), F.col("value")).otherwise(F.lower("value"))
    place = F.struct("chunk", "pos")
    one = facts.withColumn("key", key).groupBy("company", "section", "field", "key").agg(
        F.min_by("value", place).alias("value"), F.min(place).alias("place"), F.least(F.count("*"), F.lit(EVIDENCE_CAP)).alias("evidence")
    )
    order = Window.partitionBy("company", "section", "field").orderBy("place", "key")
    cap = F.lit(LIST_CAP)
    for field, most in LIST_CAPS.items():
        cap = F.when(F.col("field") == field, most).otherwise(cap)
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LIST_CAP).where(F.col("rank") <= cap)
    return ranked.select("company", "section", "field", "rank", "value", "evidence")


def merged_identity(facts: DataFrame) -> DataFrame:
    """company, cnpj, company_name, founding_year (first of each) and the shortest description, ties to the first."""
    own = facts.where(F.col("section") == "identity")
    place = F.struct("chunk", "pos")
    first = lambda name: F.min_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, place)).alias(name)
    is_text = F.col("field") == "description"
    shortest = F.min_by(F.when(is_text, F.col("value")), F.when(is_text, F.struct(F.char_length("value"), place)))
    return own.groupBy("company").agg(first("cnpj"), first("company_name"), first("founding_year"), shortest.alias("description"))
