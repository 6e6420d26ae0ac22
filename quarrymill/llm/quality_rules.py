"""Quality rules with host verdicts.

Each document is measured against base rules, which reject it by themselves, and soft rules,
which alone do not. Failures are then counted by host (source) and rule, and each host's rate
is shrunk towards all hosts' with a beta prior fitted to them by moments, so that a host of few
documents is not judged by chance. The prior's spread is what hosts differ by beyond what
chance gives, so where they do not differ no host is flagged. On a host flagged for a rule, documents that fail that rule
are rejected too, soft or not. A document that fails no rule is kept whatever its host.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACES, by_slices, staged

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MIN_WORD_CHARS, MAX_WORD_CHARS = 10, 30, 3, 12
#: A host is flagged for a rule if its shrunk failure rate is so many times that of all documents, or so high in any case.
HOST_FACTOR, HOST_LIMIT = 2.0, 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1_000_000.0
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the list holds at least twice."""
    if len(words) < 4:
        return 0
    number = {word: i for i, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # else the product below fits 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(hit)] |= hit
    return int(inside.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES; a null text has no words and no lines."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # for bytes: at space and U+0009 to U+000D only
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of every row and its MEASURES; narrow, without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure_text(text) for text in batch.column(0).to_pylist()]
        values = zip(*found, strict=True) if found else [()] * len(MEASURES)
        arrays = batch.columns[1:] + [pa.array(column, pa.int64()) for column in values]
        return pa.RecordBatch.from_arrays(arrays, [*carry, *MEASURES])

    kinds = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in carry]
    return docs.select("text", *carry).mapInArrow(by_slices(work), ", ".join(kinds + [f"{name} long" for name in MEASURES]))


def rules() -> dict[str, Column]:
    """Rule name -> true where a measured document fails it; the first two are the base rules."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < MIN_WORD_CHARS * n) | (F.col("word_chars") > MAX_WORD_CHARS * n),
    }


BASE = ("short", "repetitive")


def host_verdicts(documents: DataFrame, host: str = "source", factor: float = HOST_FACTOR, limit: float = HOST_LIMIT) -> DataFrame:
    """Measured documents -> hosts with ``flags``: for each rule whether the host is flagged for it."""
    failures = [F.sum(failed.cast("long")).alias(name) for name, failed in rules().items()]
    hosts = staged(documents.groupBy(host).agg(F.count("*").alias("docs"), *failures), "hosts")
    totals = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"), *[F.sum(name).alias(name) for name in rules()]).first()
    mean = {name: (totals[name] or 0) / max(1, totals["docs"] or 0) for name in rules()}
    spread = hosts.agg(
        *[F.sum(F.col("docs") * F.pow(F.col(name) / F.col("docs") - mean[name], 2)).alias(name) for name in rules()]
    ).first()
    flags = []
    for name in rules():
        docs = max(1, totals["docs"] or 0)
        binomial = mean[name] * (1 - mean[name])
        between = (spread[name] or 0) / docs - binomial * (totals["hosts"] - 1) / docs
        weight = min(max(binomial / between - 1, PRIOR_LEAST), PRIOR_MOST) if between > 0 else PRIOR_MOST
        shrunk = (F.col(name) + mean[name] * weight) / (F.col("docs") + weight)
        flags.append(((F.col(name) > 0) & (shrunk >= min(limit, factor * mean[name]))).alias(name))
    return hosts.select(host, F.struct(*flags).alias("flags"))


def judged(documents: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Measured documents with base_failed and kept."""
    flagged = reduce(lambda a, b: a | b, (F.col(f"flags.{name}") for name in rules()))
    # Only flagged hosts travel; staged, so that this side is broadcast only if its files are small.
    bad = staged(verdicts.where(flagged), "flagged-hosts").withColumnRenamed(host, "_host")
    joined = documents.join(bad, F.col(host).eqNullSafe(F.col("_host")), "left")
    base = reduce(lambda a, b: a | b, (rules()[name] for name in BASE))
    by_host = reduce(lambda a, b: a | b, (failed & F.coalesce(F.col(f"flags.{name}"), F.lit(False)) for name, failed in rules().items()))
    return joined.withColumn("base_failed", base).withColumn("kept", ~(base | by_host)).drop("_host", "flags")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept of every row.

    Null or empty text has no words and fails for being short. Null sources form one host.
    Repeated rows and null ids are judged row by row and all count for their host. Texts have no
    length limit; an empty table gives an empty result. Other columns are left out, so clashing
    names do no harm.
    """
    documents = staged(measured(docs, ["doc_id", "source"]), "measures")
    return judged(documents, host_verdicts(documents)).drop("source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with the columns of ``docs``.

    Cases as there. Texts are measured once for the hosts and again for their own verdicts, which
    is cheaper than writing and reading every text between. They stay where they are unless the
    flagged hosts are too many to broadcast.
    """
    names = {name: f"_own_{name}" for name in docs.columns if name in (*MEASURES, "base_failed", "kept", "flags")}
    own = docs.withColumnsRenamed(names)
    verdicts = host_verdicts(staged(measured(docs, ["source"]), "measures"))
    kept = judged(measured(own, own.columns), verdicts).where("kept").select(*own.columns)
    return kept.withColumnsRenamed({new: old for old, new in names.items()})
