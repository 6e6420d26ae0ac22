"""Nested sections of company profiles merged by name: categories, service details, case studies.

An entry is a row: company, place (order of being seen), a name, lists and texts. Entries of one
name become one: lists are united in the order in which values were first seen, texts keep the
longest, or both where a joined text complements the one before. Rows meet by (company, name),
so no company is ever held whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.folds import folded_texts, ordered_unions
from quarrymill.staging import staged


def longest(text: str, place: str) -> Column:
    """The longest text of a group that is not blank, the first of equals by ``place``."""
    filled = F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.col(text))
    return F.min_by(filled, F.when(filled.isNotNull(), F.struct(-F.char_length(text), F.col(place)))).alias(text)


def merged_entries(entries: DataFrame, name: str, place: str, lists: list[str], longest_of: list[str], joined: list[str], keep: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """One row for each company and name: ``lists`` united, ``longest_of`` texts (the first of equals), ``joined`` texts folded in order, and ``seen``, the first place.

    Entries without a name go. A text that no entry has is null, a list that none has is empty.
    ``place`` is of any type that can be ordered. Entries are staged, so that what they come
    from is computed once; ``keep`` may leave them as they are, where that costs less.
    """
    keys = ["company", name]
    named = keep(entries.where(F.coalesce(F.trim(name), F.lit("")) != ""), "entries")
    full = named.groupBy(*keys).agg(*[longest(t, place) for t in longest_of], F.min(place).alias("seen"))
    if joined:
        full = full.join(folded_texts(named, keys, [place], joined), keys)
    if lists:
        full = full.join(ordered_unions(named, keys, lists, place), keys, "left")
    empty = F.array().cast("array<string>")
    return full.withColumns({values: F.coalesce(values, empty) for values in lists})


def section_fill(filled: list[Column]) -> Column:
    """Share of a section's fields that hold something."""
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in filled]) / len(filled), 4)


def cap_hits(sizes: dict[str, Column], caps: dict[str, int]) -> Column:
    """Share of lists that reach their cap."""
    return F.round(reduce(lambda a, b: a + b, [(sizes[name] >= most).cast("int") for name, most in caps.items()]) / len(caps), 4)
