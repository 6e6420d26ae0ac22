"""Lines of documents: removal within a document, white space, quality counters, repetition loops."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import lines_of

MIN_LINE = 5


def bare(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+$", "")


def with_previous(items: Column) -> Column:
    """(item, previous) of each element; lambdas then need no look-up in the array, which would be evaluated anew for each."""
    pairs = F.zip_with(items, F.concat(F.array(F.lit(None)), items), lambda item, previous: F.struct(item.alias("item"), previous.alias("previous")))
    return F.slice(pairs, F.lit(1), F.size(items))


def keep_first_lines(lines: Column, least: int = MIN_LINE) -> Column:
    """Lines without later copies; lines under ``least`` characters always stay.

    Works inside the row, so a document is never shuffled: sorted by line, a copy stands right
    after its first.
    """
    indexed = F.transform(lines, lambda x, i: F.struct(bare(x).alias("key"), i.alias("at"), x.alias("line")))
    long = F.array_sort(F.filter(indexed, lambda x: F.char_length(x["key"]) >= least))  # by key, then place
    first = F.filter(with_previous(long), lambda p: p["previous"].isNull() | (p["previous"]["key"] != p["item"]["key"]))
    short = F.filter(indexed, lambda x: F.char_length(x["key"]) < least)
    by_place = lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))
    kept = F.array_sort(F.concat(F.transform(first, lambda p: by_place(p["item"])), F.transform(short, by_place)))
    return F.transform(kept, lambda x: x["line"])


def drop_consecutive_lines(lines: Column, least: int = MIN_LINE) -> Column:
    """Lines unlike the one right before; a line under ``least`` characters stays and stands between."""
    kept = F.filter(
        with_previous(lines),
        lambda p: p["previous"].isNull() | (F.char_length(bare(p["item"])) < least) | (bare(p["item"]) != bare(p["previous"])),
    )
    return F.transform(kept, lambda p: p["item"])


def normal_whitespace(text: Column) -> Column:
    """Lines without white space at the end, each closed by a newline, at most two blank ones in a row."""
    closed = F.regexp_replace(F.regexp_replace(text, r"\n\z", ""), r"(?U)[^\S\n]+(?=\n|\z)", "")
    whole = F.when(text == "", "").otherwise(F.concat(closed, F.lit("\n")))
    inner = F.regexp_replace(whole, r"(?<=[^\n])\n{3,}", "\n\n\n")
    return F.regexp_replace(inner, r"^\n{2,}", "\n\n")


def preprocess(docs: DataFrame, scope: str = "document") -> DataFrame:
    """doc_id, text, original, unique, removed, reduction, chars_before, chars_after of each document."""
    lines = lines_of(F.col("text"))
    kept = keep_first_lines(lines) if scope == "document" else drop_consecutive_lines(lines)
    cut = docs.select("doc_id", F.char_length("text").alias("chars_before"), F.size(lines).alias("original"), kept.alias("kept"))
    done = cut.withColumn("unique", F.size("kept")).withColumn("text", normal_whitespace(F.array_join("kept", "\n")))
    return done.select(
        "doc_id",
        "text",
        "original",
        "unique",
        (F.col("original") - F.col("unique")).alias("removed"),
        F.when(F.col("original") == 0, 0.0).otherwise(F.round(100 * (F.col("original") - F.col("unique")) / F.col("original"), 1)).alias("reduction"),
        "chars_before",
        F.char_length("text").alias("chars_after"),
    )


def quality_counters(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n", -1)
    again = F.filter(with_previous(lines), lambda p: (p["item"] == p["previous"]) & (F.trim(p["item"]) != ""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "total_length": F.char_length(text),
        "newlines": count(r"\n"),
        "tabs": count(r"\t"),
        "spaces": count(" "),
        "blank_runs": count(r"\n{3,}"),
        "space_runs": count(" {3,}"),
        "non_ascii": count(r"[^\x00-\x7f]"),
        "control": count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
        "duplicate_lines": F.size(again),
        "total_lines": F.size(lines),
        "avg_line_length": F.round((F.char_length(text) - F.size(lines) + 1) / F.size(lines), 4),
    }


WORD = re.compile(r"\w+")


def most_repeats(text: str) -> tuple[int, int]:
    """How often the most frequent run of 4 words, and piece of 30 characters, occur; 0 without any.

    Pieces start every 10 characters, the last one 31 or more before the end; those under 20
    characters without outer spaces don't count.
    """
    words = WORD.findall(text.lower())
    runs = Counter(zip(words, words[1:], words[2:], words[3:]))
    pieces = Counter(piece for at in range(0, len(text) - 30, 10) if len(piece := text[at : at + 30].strip(" ")) >= 20)
    return max(runs.values(), default=0), max(pieces.values(), default=0)


def loop_flags(docs: DataFrame) -> DataFrame:
    """doc_id, max_ngram, max_piece, looping: repeated 4-word runs, repeated 30-character pieces, or long text without a closing brace.

    A run may repeat 20 times, a piece 15 times; texts under 100 characters never loop. Runs and
    pieces of a document are counted where it is, in Arrow batches: nothing is shuffled, and
    counters in Python take a tenth of the time that sorted arrays in the row do.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text, n = F.col("text"), F.char_length("text")
    rows = docs.select("doc_id", text, n.alias("chars"), ((n > 8000) & ~F.endswith(F.rtrim(text), F.lit("}"))).alias("unclosed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [most_repeats(text or "") for text in batch.column(1).to_pylist()]
            counts = [pa.array([pair[i] for pair in found], pa.int32()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *counts], ["doc_id", "chars", "unclosed", "max_ngram", "max_piece"])

    found = rows.mapInArrow(run, f"doc_id {kind}, chars int, unclosed boolean, max_ngram int, max_piece int")
    many = (F.col("max_ngram") > 20) | (F.col("max_piece") > 15) | F.col("unclosed")
    return found.select("doc_id", "max_ngram", "max_piece", ((F.col("chars") >= 100) & many).alias("looping"))
