"""Partial profiles of a company merged into one.

A partial profile is a row: company, chunk, name, tagline, description, products, services,
emails, sources. Scores, lists and longest texts merge by built-in aggregates; joined texts merge
by an ordered fold that is not associative, streamed over sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.folds import folded_texts
from quarrymill.staging import staged

# Characters of text worth one list entry; overlap from which texts tell the same.
TEXT_DIVISOR, SIMILAR = 10, 0.3
TEXTS, LISTS = ("name", "tagline", "description"), ("products", "services", "emails", "sources")
JOINED = ("description", "tagline")
# Names that say nothing about a category.
GENERIC_CATEGORIES = ("outras categorias", "outras", "marcas", "marca", "geral", "diversos", "outros", "categorias", "categoria", "produtos", "produto")


def completeness(texts: list[Column], lists: list[Column]) -> Column:
    """Entries of all lists and a tenth of the characters of each text."""
    parts = [F.coalesce(F.floor(F.char_length(t) / TEXT_DIVISOR), F.lit(0)) for t in texts]
    parts += [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long") for x in lists]
    return sum(parts[1:], parts[0])


def scored(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("score", completeness([F.col(t) for t in TEXTS], [F.col(x) for x in LISTS]))


def base_profiles(profiles: DataFrame) -> DataFrame:
    """company, chunk, score of each company's most complete profile, the first of equals."""
    best = scored(profiles).groupBy("company").agg(F.max_by(F.struct("chunk", "score"), F.struct("score", -F.col("chunk"))).alias("b"))
    return best.select("company", "b.chunk", "b.score")


def complementary(a: Column, b: Column) -> Column:
    """Neither text holds the other and they share few of their words."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(x), words(y))) / F.greatest(F.size(words(x)), F.size(words(y)))
    return (x != "") & (y != "") & ~F.contains(x, y) & ~F.contains(y, x) & (shared < SIMILAR)


def merged_lists(profiles: DataFrame) -> DataFrame:
    """company and the sorted union of each list over its profiles; blank entries go."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("values")) for c in LISTS])).alias("_l")
    long = profiles.select("company", each).select("company", "_l.list", F.explode_outer("_l.values").alias("_value"))
    distinct = long.withColumn("_value", F.when(F.trim("_value") != "", F.col("_value"))).distinct()  # before any company meets
    return distinct.groupBy("company").agg(*[F.array_sort(F.collect_list(F.when(F.col("list") == c, F.col("_value")))).alias(c) for c in LISTS])


def in_fold_order(profiles: DataFrame) -> DataFrame:
    """``profiles`` (company, chunk, score, ...) with rank: the company's base profile first, the others by chunk.

    They are read for the bases and again for the rows, so they should be staged. The bases are
    staged here: two columns, so that their size tells Spark whether to broadcast them.
    """
    best = staged(profiles.groupBy("company").agg(F.max_by("chunk", F.struct("score", -F.col("chunk"))).alias("_base")), "bases")
    return profiles.join(best, "company").withColumn("rank", F.struct((F.col("chunk") != F.col("_base")).alias("other"), "chunk")).drop("_base")


def merged_texts(profiles: DataFrame) -> DataFrame:
    """company and its texts, folded from the most complete profile (the first of equals) over the others in order of chunks."""
    ranked = in_fold_order(scored(profiles).select("company", "chunk", "score", *TEXTS))
    alone = [t for t in TEXTS if t not in JOINED]
    longest = [F.min_by(t, F.struct(-F.char_length(t), F.col("rank"))).alias(t) for t in alone]
    merged = ranked.groupBy("company").agg(*longest).join(folded_texts(ranked, ["company"], ["rank"], list(JOINED)), "company")
    return merged.select("company", *[F.coalesce(t, F.lit("")).alias(t) for t in TEXTS])


def merge_profiles(profiles: DataFrame) -> DataFrame:
    whole = staged(profiles, "profiles")  # read for texts and for lists
    return merged_texts(whole).join(merged_lists(whole), "company")


def named_categories(rows: DataFrame, name: str) -> DataFrame:
    """Without rows whose category has no name or a generic one."""
    return rows.where((F.trim(name) != "") & ~F.lower(F.trim(name)).isin(*GENERIC_CATEGORIES))


def is_empty_profile(texts: list[Column], lists: list[Column]) -> Column:
    out = F.lit(True)
    for t in texts:
        out &= F.coalesce(F.trim(t), F.lit("")) == ""
    for x in lists:
        out &= F.coalesce(F.size(x), F.lit(0)) <= 0
    return out


def fill_rate(filled: list[Column]) -> Column:
    return F.round(sum((f.cast("int") for f in filled[1:]), filled[0].cast("int")) / len(filled), 4)
