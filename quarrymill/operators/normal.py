"""Loose answers in JSON rewritten to one profile schema, over Variant values.

The schema says of each field what it is: a text, a list of texts, a list of objects. A rewriter
for each kind takes whatever value is there and gives the field's type; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of an entry that may name it, and how a case study without a title is called.
NAMING_FIELDS = ("name", "title", "partner_name", "company", "client_name", "certification", "award")
CASE_TITLES = (("challenge", "Desafio: {}..."), ("solution", "Solução: {}..."), ("client_name", "Caso: {}"))
UNTITLED, TITLE_CHARS = "Estudo de Caso (Sem Título)", 50

Rewriter = Callable[[Column], Column]


def parts(value: Column, fields: Iterable[str]) -> Column:
    """An object's fields as a struct of variants, in one step; null for anything else."""
    return F.try_variant_get(value, "$", f"struct<{', '.join(f'{field}: variant' for field in fields)}>")


def elements(value: Column) -> Column:
    """The elements of a list as variants; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def items(value: Column) -> Column:
    """As `elements`; empty for anything else."""
    return F.coalesce(elements(value), F.array().cast("array<variant>"))


def string(value: Column) -> Column:
    """The text of a string; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def text(value: Column) -> Column:
    """A scalar as text; null for none, blank text, lists and objects."""
    kind = F.substring(F.schema_of_variant(value), 1, 5)
    plain = F.when((kind != "ARRAY") & (kind != "OBJEC"), F.try_variant_get(value, "$", "string"))
    return F.when(F.trim(plain) != "", plain)


def stripped(values: Column) -> Column:
    """Texts stripped and without blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def texts(value: Column) -> Column:
    """The strings of a list; empty for anything else."""
    return stripped(F.transform(items(value), string))


def texts_or_one(value: Column) -> Column:
    """As `texts`; one string is a list of one."""
    return F.when(elements(value).isNull(), stripped(F.array(string(value)))).otherwise(texts(value))


def names(value: Column) -> Column:
    """As `texts_or_one`; an object in the list stands for the first of its fields that may name it."""
    both = F.transform(items(value), lambda x: F.struct(string(x).alias("own"), parts(x, NAMING_FIELDS).alias("of")))
    told = F.transform(both, lambda x: F.concat(F.array(x["own"]), F.array(*[string(x["of"][f]) for f in NAMING_FIELDS])))
    names = F.transform(told, lambda x: F.get(F.filter(x, lambda name: F.trim(name) != ""), 0))
    return F.when(elements(value).isNull(), stripped(F.array(string(value)))).otherwise(stripped(names))


def first_url(mark: Callable[[Column], Column]) -> Rewriter:
    """A string, or the first string of a list that has the mark."""

    def rewrite(value: Column) -> Column:
        some = F.filter(F.transform(items(value), string), lambda x: F.coalesce((F.trim(x) != "") & mark(x), F.lit(False)))
        one = F.trim(F.when(elements(value).isNotNull(), F.get(some, 0)).otherwise(string(value)))
        return F.when(one != "", one)

    return rewrite


def address(value: Column) -> Column:
    """A string, or the first element of a list as text."""
    return F.when(elements(value).isNotNull(), text(F.get(elements(value), 0))).otherwise(string(value))


def objects(fields: dict[str, Rewriter], keep: str) -> Rewriter:
    """The objects of a list whose field ``keep`` is not null once rewritten."""
    shaped = lambda x: F.struct(*[rewrite(x[f]).alias(f) for f, rewrite in fields.items()])

    def rewrite(value: Column) -> Column:
        taken = F.filter(F.transform(items(value), lambda x: parts(x, fields)), lambda x: x.isNotNull())
        return F.filter(F.transform(taken, shaped), lambda x: x[keep].isNotNull())

    return rewrite


def named(value: Column) -> Column:
    """A name: a string that is not blank."""
    return F.when(F.trim(string(value)) != "", string(value))


def case_studies(value: Column) -> Column:
    """Case studies; one without a title is named by what it tells, and goes if it tells nothing."""
    fields = ("title", "client_name", "industry", "challenge", "solution", "outcome")

    def titled(case: Column) -> Column:
        title = case["title"]
        for field, form in CASE_TITLES:
            told = case[field] if field == "client_name" else F.substring(case[field], 1, TITLE_CHARS)
            before, after = form.split("{}")
            title = F.coalesce(title, F.concat(F.lit(before), told, F.lit(after)))
        tells = F.coalesce(*[case[f] for f in fields]).isNotNull()
        return F.struct(F.coalesce(title, F.when(tells, F.lit(UNTITLED))).alias("title"), *[case[f].alias(f) for f in fields[1:]])

    loose = objects({f: text for f in fields} | {"_all": lambda _: F.lit(True)}, "_all")(value)
    return F.filter(F.transform(loose, titled), lambda case: case["title"].isNotNull())


#: The profile's sections and what each field is.
PROFILE: dict[str, dict[str, Rewriter]] = {
    "identity": dict.fromkeys(("company_name", "cnpj", "tagline", "description", "founding_year", "employee_count_range"), text),
    "classification": dict.fromkeys(("industry", "business_model", "target_audience", "geographic_coverage"), text),
    "team": {"size_range": text, "key_roles": texts_or_one, "team_certifications": texts_or_one},
    "offerings": {
        "products": texts, "services": texts, "engagement_models": texts, "key_differentiators": texts,
        "product_categories": objects({"category_name": named, "items": texts}, "category_name"),
        "service_details": objects({"name": named, "description": text, "methodology": text, "ideal_client_profile": text, "deliverables": texts}, "name"),
    },
    "reputation": {"certifications": names, "awards": names, "partnerships": names, "client_list": names, "case_studies": case_studies},
    "contact": {
        "emails": texts_or_one, "phones": texts_or_one, "locations": texts_or_one, "headquarters_address": address,
        "website_url": first_url(lambda x: F.startswith(x, F.lit("http"))), "linkedin_url": first_url(lambda x: F.contains(F.lower(x), F.lit("linkedin"))),
    },
}
SECTIONS = (*PROFILE, "sources")


def normal_profiles(answers: DataFrame, body: str) -> DataFrame:
    """``answers`` with a column for each section of the profile in place of ``body``.

    An answer that is a list stands for its first element. One that is no JSON or no object, and
    a section that is none, give empty sections: null texts and empty lists. In a list of texts
    other values go, in a list of objects those without a name go. A number or truth value in a
    text field is its text.
    """
    whole = F.try_parse_json(body)
    rest = [c for c in answers.columns if c != body]
    parsed = answers.select(*rest, whole.alias("_whole"))
    one = parsed.select(*rest, F.when(elements(F.col("_whole")).isNotNull(), F.get(elements(F.col("_whole")), 0)).otherwise(F.col("_whole")).alias("_answer"))
    # Each step is a projection of its own, so that an object is taken apart once and not for each of its fields.
    whole = one.select(*rest, parts(F.col("_answer"), SECTIONS).alias("_parts"))
    taken = whole.select(*rest, *[parts(F.col(f"_parts.{name}"), kinds).alias(f"_{name}") for name, kinds in PROFILE.items()], texts(F.col("_parts.sources")).alias("sources"))
    sections = [F.struct(*[rewrite(F.col(f"_{name}.{f}")).alias(f) for f, rewrite in kinds.items()]).alias(name) for name, kinds in PROFILE.items()]
    return taken.select(*rest, *sections, "sources")


def founding_year(told: Column) -> Column:
    """A year told as a whole number, null for any other text."""
    return F.when(told.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.regexp_replace(told, r"\s", "").try_cast("int"))


def profile_json(profiles: DataFrame) -> Column:
    """The nested profile as one JSON text, null fields included, as it is stored."""
    return F.to_json(F.struct(*SECTIONS), {"ignoreNullFields": "false"})


def completeness(profiles: DataFrame, divisor: int = 10) -> Column:
    """Entries of all lists and a tenth of the characters of each text, over all sections."""
    parts = [F.size("sources").cast("long")]
    for name, fields in PROFILE.items():
        kinds = profiles.schema[name].dataType
        for f in fields:
            value = F.col(f"{name}.{f}")
            is_text = kinds[f].dataType.typeName() == "string"
            parts.append(F.coalesce(F.floor(F.char_length(value) / divisor) if is_text else F.size(value).cast("long"), F.lit(0)))
    return sum(parts[1:], parts[0])
