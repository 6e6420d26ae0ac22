"""Partial profiles of all sections merged into one nested profile for each company.

A partial profile is a row of `normal.normal_profiles`: company (or companies, all that share
it), chunk and the profile's sections. The company's most complete profile is the base, the
others follow by chunk. Single texts keep the longest, tagline and description are folded in that
order, lists of team and contact are those of the first profile that has any, other lists are
united, and services, categories and case studies of one name become one. Every part is an
aggregation or a stream, so no company is held whole before its merged profile.

Texts and lists don't travel with the companies' rows. Each distinct one is written once under a
code; the rows hold lengths and codes, or one code for all of these where few sets of them occur.
They meet by company in one shuffle and are written in buckets, so that what follows needs no
other for them. Codes become texts where they are merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.folds import folded_texts, listed_unions
from quarrymill.operators.normal import PROFILE, SECTIONS, completeness, profile_json
from quarrymill.operators.profiles import named_categories
from quarrymill.operators.sections import merged_entries
from quarrymill.staging import in_buckets, staged, tasks_for

#: Texts that are folded, and sections whose lists are not united.
FOLDED, FIRST_LISTS = ("tagline", "description"), ("team", "contact")
#: Shift of a place in an order of two parts, the second an integer.
WHOLE = 32
#: Companies' rows in a task, which sorts them for several sections at once.
ROWS = 250_000
#: Most sets of lengths and codes that go under one code; some 300 bytes each, they are broadcast.
SHAPES = 1 << 17
#: Entries of nested sections: section, field, name, lists, longest texts, folded texts.
ENTRIES = (
    ("offerings", "product_categories", "category_name", ["items"], [], []),
    ("offerings", "service_details", "name", ["deliverables"], ["ideal_client_profile"], ["description", "methodology"]),
    ("reputation", "case_studies", "title", [], ["client_name", "industry", "challenge", "solution", "outcome"], []),
)


def _last_of_name(entries: Column, name: str) -> Column:
    """Entries without those whose name comes again later in the list."""
    return F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y[name] == x[name]))


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` with place, in their company, for score: 0 for the most complete profile (the first of equals), the others follow by chunk."""
    company = Window.partitionBy("company")
    best = rows.withColumn("_best", F.row_number().over(company.orderBy(F.col("score").desc(), "chunk")))
    return best.withColumn("place", F.when(F.col("_best") == 1, 0).otherwise(F.row_number().over(company.orderBy("chunk")))).drop("score", "_best")


def _after(first: Column, second: Column) -> Column:
    """An order by two integers as one number."""
    return F.shiftleft(first.cast("long"), WHOLE) + second


def coded(rows: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a code in place of each list (null for none and empty ones), and the staged lists: values, code."""
    distinct = rows.select(F.explode(F.array(*columns)).alias("values")).where(F.size("values") > 0).distinct()
    known = staged(distinct.withColumn("code", F.monotonically_increasing_id()), name)
    own = known.select(F.col("values").alias("_values"), F.col("code").alias("_code"))  # the same for all columns, so that it is broadcast once
    for c in columns:
        rows = rows.join(own, F.col(c) == F.col("_values"), "left").withColumn(c, F.col("_code")).drop("_values", "_code")
    return rows, known


def _entries(ranked: DataFrame, buckets: int, known: DataFrame, field: str, name: str, lists: list[str], longest: list[str], joined: list[str]) -> DataFrame:
    """company and the section's merged entries in the order in which their names were first seen."""
    rows = ranked.where(F.col(field).isNotNull()).select("company", "place", F.col(field).alias("code"))
    if not joined:  # what comes again adds nothing, but the base is read in a way of its own
        rows = rows.groupBy("company", "code", (F.col("place") > 0).alias("_other")).agg(F.min("place").alias("place")).drop("_other")
    # In the base the last entry of a name counts; elsewhere those of one name are merged.
    held = F.when(F.col("place") > 0, F.col("values")).otherwise(_last_of_name(F.col("values"), name))
    each = rows.join(known, "code").select("company", "place", F.posexplode(held).alias("_pos", "_entry"))
    flat = each.select("company", _after(F.col("place"), F.col("_pos")).alias("place"), "_entry.*")
    if name == "category_name":
        flat = named_categories(flat, name)
    merged = merged_entries(flat, name, "place", lists, longest, joined, keep=lambda entries, _: entries)
    merged = merged.repartition(buckets, "company") if lists else merged  # as the buckets, where a join has dealt them by name
    order = [f.name for f in known.schema["values"].dataType.elementType]
    together = F.array_sort(F.collect_list(F.struct("seen", F.struct(*order).alias("entry"))))
    return merged.groupBy("company").agg(F.transform(together, lambda x: x["entry"]).alias(field))


def _in_buckets(rows: DataFrame) -> tuple[DataFrame, int]:
    """company, place, id and the fields of shape for each of the rows' companies, in buckets by company, and how many these are."""
    rows = staged(rows, "coded")
    shapes = staged(rows.select("shape").distinct().withColumn("code", F.monotonically_increasing_id()), "shapes")
    buckets = tasks_for(rows.select(F.explode("companies")), ROWS)
    if few := shapes.count() <= SHAPES:
        rows = rows.join(F.broadcast(shapes), "shape").drop("shape").withColumnRenamed("code", "shape")
    members = rows.select(F.explode("companies").alias("company"), "id", "chunk", "score", "shape")

    def placed(some: DataFrame) -> DataFrame:
        ranked = _places(some)  # while rows are narrow
        ranked = ranked.withColumnRenamed("shape", "code").join(F.broadcast(shapes), "code") if few else ranked
        return ranked.select("company", "place", "id", "shape.*")

    return in_buckets(members, "ranked", "company", buckets, placed), buckets


def _picked(ranked: DataFrame, own: DataFrame, singles: dict[str, Column], firsts: dict[str, Column]) -> DataFrame:
    """company, the longest text of each of ``singles``, and of each of ``firsts`` the first list that is not empty."""
    place = F.col("place")
    longest = [F.min_by("id", F.when(F.col(c).isNotNull(), _after(-F.col(c), place))).alias(c) for c in singles]
    first = [F.min_by("id", F.when(F.col(c) > 0, place)).alias(c) for c in firsts]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("id")) for c in (*singles, *firsts)])).alias("_p")
    picks = ranked.groupBy("company").agg(*longest, *first).select("company", each).select("company", "_p.*").where("id IS NOT NULL")
    values = {c: F.array(text) for c, text in singles.items()} | firsts
    found = picks.join(own.select("id", *PROFILE), "id").select("company", "field", F.coalesce(*[F.when(F.col("field") == c, v) for c, v in values.items()]).alias("value"))
    of = {c: F.max(F.when(F.col("field") == c, F.col("value"))) for c in values}
    return found.groupBy("company").agg(*[(F.get(v, 0) if c in singles else v).alias(c) for c, v in of.items()])


def merged_profiles(profiles: DataFrame) -> DataFrame:
    """company, profiles (how many there were), and the sections of one merged profile.

    Chunks of a company should differ; equal ones fold in no fixed order. Lists are in
    first-seen order, without blanks and repeats. A company of one profile is merged and
    cleaned like any other. With ``companies`` in place of company a profile is one of each of
    them; such profiles have an id, in which all differ, and should be staged.
    """
    own = profiles
    if "companies" not in profiles.columns:
        own = staged(profiles.select(F.monotonically_increasing_id().alias("id"), F.array("company").alias("companies"), "chunk", *SECTIONS), "profiles")
    texts, singles, firsts, unions = {}, {}, {}, {"sources": F.col("sources")}
    for section, fields in PROFILE.items():
        for field in fields:
            kind, name, value = own.schema[section].dataType[field].dataType, f"{section}_{field}", F.col(f"{section}.{field}")
            if kind.typeName() == "string":
                (texts if field in FOLDED else singles)[name] = value
            elif kind.elementType.typeName() == "string":
                (firsts if section in FIRST_LISTS else unions)[name] = value
    nested = {field: F.col(f"{section}.{field}") for section, field, *_ in ENTRIES}
    lists = {c: F.when(text.isNotNull(), F.array(text)) for c, text in texts.items()} | unions
    sizes = [*[F.char_length(text).alias(c) for c, text in singles.items()], *[F.size(values).alias(c) for c, values in firsts.items()]]
    rows = own.withColumn("score", completeness(own)).select("id", "companies", "chunk", "score", F.struct(*sizes).alias("sizes"), *[v.alias(c) for c, v in (nested | lists).items()])
    entries = {}
    for field in nested:
        rows, entries[field] = coded(rows, [field], field)
    rows, known = coded(rows, [*lists], "lists")
    ranked, buckets = _in_buckets(rows.select("id", "companies", "chunk", "score", F.struct("sizes.*", *nested, *lists).alias("shape")))

    told = ranked.select("company", "place", *texts)
    for c in texts:
        told = told.join(known.withColumnRenamed("code", c), c, "left").withColumn(c, F.col("values")[0]).drop("values")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("code")) for c in unions])).alias("_l")
    seen = ranked.select("company", "place", each).select("company", "place", "_l.*").where("code IS NOT NULL").groupBy("company", "list", "code").agg(F.min("place").alias("place"))
    united = listed_unions(seen.join(known, "code"), ["company"], [*unions], F.col("place"), _after)
    parts = [_picked(ranked, own, singles, firsts), united, *[_entries(ranked, buckets, entries[field], field, *how) for _, field, *how in ENTRIES]]
    counted = ranked.groupBy("company").agg(F.count("*").alias("profiles")).join(folded_texts(told, ["company"], ["place"], [*texts]), "company")
    whole = reduce(lambda a, b: a.join(b, "company", "left"), parts, counted)

    def merged(section: str, field: str) -> Column:
        kind = own.schema[section].dataType[field].dataType
        name = field if field in nested else f"{section}_{field}"
        return F.col(name) if kind.typeName() == "string" else F.coalesce(name, F.array().cast(kind))

    sections = [F.struct(*[merged(section, f).alias(f) for f in fields]).alias(section) for section, fields in PROFILE.items()]
    return whole.select("company", "profiles", *sections, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def merged_json(profiles: DataFrame) -> DataFrame:
    """company and its merged profile as the JSON text that is stored."""
    merged = merged_profiles(profiles)
    return merged.select("company", profile_json(merged).alias("profile_json"))
