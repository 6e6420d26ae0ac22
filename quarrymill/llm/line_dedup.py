"""Removal of lines that another document already has, without Python.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned and sorted by
document and position, and the first occurrence streams out of each group. A key may occur in
a third of all documents, so this takes two rounds: first within (key, block of documents),
then among the blocks' first documents. With sqrt(documents) blocks neither round has a group
of more than about sqrt(documents) documents. Positions travel, text does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACES, staged, text_or_empty

MIN_KEY_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case and all else as it is."""
    bare = F.trim(line, F.lit(SPACES))
    # lower() would also change letters outside A-Z; it is the faster way where there are none.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_key_chars: int, blocks: int) -> DataFrame:
    """doc_id, version, block, pos and the two hash halves of every line with a long enough key."""
    # The version is computed below the explode, once for a text and not once for a line.
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64(text_or_empty()).alias("version"), F.split(text_or_empty(), "\n", -1).alias("lines")
    )
    lines = texts.select("doc_id", "version", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_key_chars).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("line"), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"),
        "doc_id",
        "version",
        "pos",
    )


def repeated_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc_id, version, pos of each line to drop: a smaller doc_id has its key."""
    blocks = max(64, math.isqrt(docs.count()))
    hashes = staged(line_hashes(docs, min_key_chars, blocks), "line-hashes")
    within = Window.partitionBy("h1", "h2", "block").orderBy("doc_id", "pos")
    local = hashes.repartitionByRange("h1", "h2", "block").withColumn("first", F.first("doc_id").over(within))
    local = staged(local.withColumn("later", F.col("doc_id") > F.col("first")).drop("first"), "line-firsts")
    among = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    firsts = local.where(~F.col("later")).repartitionByRange("h1", "h2").withColumn("first", F.first("doc_id").over(among))
    columns = ["doc_id", "version", "pos"]
    return local.where("later").select(columns).unionByName(firsts.where(F.col("doc_id") > F.col("first")).select(columns))


RUNS = "array<struct<start: int, length: int>>"


def runs_of(positions: Column) -> Column:
    """Sorted distinct positions as runs (start, length) of neighbours."""
    before = F.concat(F.array(F.lit(-2)), F.slice(positions, F.lit(1), F.size(positions) - 1))
    after = F.concat(F.slice(positions, F.lit(2), F.size(positions)), F.array(F.lit(-2)))
    starts = F.array_compact(F.zip_with(positions, before, lambda at, last: F.when(at != last + 1, at)))
    ends = F.array_compact(F.zip_with(positions, after, lambda at, following: F.when(following != at + 1, at)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def runs_between(runs: Column, n_lines: Column) -> Column:
    """The runs of lines that ``runs`` leave: the one form of a keep bitmap from the other."""
    edge = lambda at: F.array(F.struct(at.alias("start"), F.lit(0).alias("length")))
    gap = lambda a, b: F.struct((a["start"] + a["length"]).alias("start"), (b["start"] - a["start"] - a["length"]).alias("length"))
    return F.filter(F.zip_with(F.concat(edge(F.lit(0)), runs), F.concat(runs, edge(n_lines)), gap), lambda run: run["length"] > 0)


def keep_bitmaps(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """Documents that lose lines: doc_id, version, drop_runs, the run-length form of the bitmap of their dropped lines."""
    lost = repeated_lines(docs, min_key_chars).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("pos")).alias("_dropped"))
    return lost.select("doc_id", "version", runs_of(F.col("_dropped")).alias("drop_runs"))


def dedup_lines(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` with text reduced to its kept lines, and n_lines, n_dropped, keep_runs.

    A line's key is the line stripped of white space with A-Z in lower case. Keys of
    ``min_key_chars`` code points or more that occur in several documents stay only in the
    smallest doc_id that has them, where all their lines stay.

    Null or empty text: one empty line, so nothing drops; null text becomes empty. A null
    doc_id takes no part and keeps its lines. Repeated rows of a doc_id share its identity:
    lines are never dropped for occurring in another row of the same doc_id. Lines and texts
    have no length limit. Empty tables give empty results. Columns named n_lines, n_dropped or
    keep_runs are replaced, all others stay.
    """
    bitmaps = keep_bitmaps(docs, min_key_chars).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("drop_runs").alias("_runs"))
    own = docs.drop("n_lines", "n_dropped", "keep_runs").withColumn("text", text_or_empty())
    joined = own.join(
        bitmaps.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_version")), "left"
    )
    # Lines and runs are columns of their own, so that cutting out a run looks nothing up anew.
    cut = joined.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_runs", F.coalesce("_runs", F.array().cast(RUNS)))
    cut = cut.withColumn("keep_runs", runs_between(F.col("_runs"), F.size("_lines")))
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda run: F.slice("_lines", run["start"] + 1, run["length"]))), "\n")
    return (
        cut.withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.aggregate("_runs", F.lit(0), lambda n, run: n + run["length"]).cast("long"))
        .withColumn("text", F.when(F.size("_runs") == 0, F.col("text")).otherwise(kept))
        .select(*[c for c in own.columns], "n_lines", "n_dropped", "keep_runs")
    )
