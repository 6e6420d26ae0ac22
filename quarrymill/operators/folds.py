"""Ordered folds of texts that are not associative, streamed over sorted rows.

Where the merge of two texts depends on all that came before, a key's texts must be folded in
order. They pass by in sorted Arrow batches and only the texts folded so far are carried on,
from batch to batch, so that a key may have any number of rows and none is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: share of common words from which two texts tell the same.
SIMILAR = 0.3


def complementary(a: str, b: str) -> bool:
    """Neither text holds the other and they share few of their words."""
    a, b = a.lower().strip(), b.lower().strip()
    if a in b or b in a:  # an empty text is in any other
        return False
    words, others = set(a.split()), set(b.split())
    return len(words & others) / max(len(words), len(others)) < SIMILAR


def tell_more(current: str | None, new: str | None) -> str | None:
    """What stays of two texts: both where they complement each other, else the longer, else the first."""
    if not new or not current:
        return current or new
    if complementary(current, new):
        return f"{current.strip()}. {new.strip()}"
    return new if len(new) > len(current) else current


def _values(column: pa.Array) -> list:
    """``to_pylist``; by NumPy where that gives the same, since a scalar for each value takes longer than the fold."""
    by_numpy = pa.types.is_string(column.type) or (pa.types.is_integer(column.type) and not column.null_count)
    return column.to_numpy(zero_copy_only=False).tolist() if by_numpy else column.to_pylist()


def folded_texts(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """``keys`` and each of ``fields`` folded by `tell_more` over the key's rows in order; null where no row has any.

    A key's rows go to one task, as its fold is sequential, but that task holds one batch and
    the folded texts.
    """
    # The window brings a key's rows together in order, by a shuffle only where they are not together.
    ordered = rows.select(*keys, *order, *fields, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_row"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    n, first = len(keys), len(keys) + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(i) for i in range(n)), *(pa.field(f, pa.string()) for f in fields)])
            done = []
            columns = [_values(batch.column(i)) for i in (*range(n), *range(first, first + len(fields)))]
            for row in zip(*columns, strict=True):
                if texts is None or row[:n] != key:
                    if texts is not None:
                        done.append((*key, *texts))
                    key, texts = row[:n], [None] * len(fields)
                texts = [tell_more(text, new) for text, new in zip(texts, row[n:], strict=True)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if texts is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *texts), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{f} string" for f in fields)]))


def ordered_unions(rows: DataFrame, keys: list[str], lists: list[str], place: str) -> DataFrame:
    """``keys`` and each of ``lists``: the distinct stripped values of all rows, in first-seen order; blanks go.

    All lists are exploded in one pass and made distinct before any meets its key.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.col(name).alias("values")) for name in lists])).alias("_l")
    return listed_unions(rows.select(*keys, F.col(place).alias("_place"), each).select(*keys, "_place", "_l.*"), keys, lists, F.col("_place"), F.struct)


def listed_unions(rows: DataFrame, keys: list[str], lists: list[str], place: Column, after: Callable[[Column, Column], Column]) -> DataFrame:
    """As `ordered_unions`, of rows with one list each: ``keys``, list (its name) and values; ``after`` gives the order by ``place`` and by the place in the list."""
    each = rows.select(*keys, place.alias("_place"), "list", F.posexplode("values").alias("_pos", "_value"))
    long = each.select(*keys, "list", after(F.col("_place"), F.col("_pos")).alias("_at"), F.trim("_value").alias("_value")).where("_value <> ''")
    first = long.groupBy(*keys, "list", "_value").agg(F.min("_at").alias("_at"))
    of = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("_at", "_value")))), lambda x: x["_value"]).alias(name)
    return first.groupBy(*keys).agg(*[of(name) for name in lists])
