"""The corpus pipeline: each stage takes what its predecessor kept, written and read again.

quality rules -> line dedup -> near-duplicates -> secret scans -> packing. All stages but the
last return the columns of documents; the last returns the packed pieces.

Null text counts as empty. Repeated rows and rows without doc_id pass every stage as rows of
their own, but for the near-duplicate stage, where wholly equal rows of a doc_id are one. Texts
have no length limit. Empty tables give empty results. Columns beyond those of documents,
whatever their names, are carried along by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import line_dedup, packing, quality_rules, secret_scan, similar
from quarrymill.llm.common import staged
from quarrymill.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _applied(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's rows in the columns of ``docs``, with n_chars as the text now has.

    Columns beyond those of documents have names that no operator uses while it runs.
    """
    aside = {name: f"_aside_{n}" for n, name in enumerate(docs.columns) if name not in DOCUMENT}
    own = docs.withColumnsRenamed(aside)
    done = operator(own).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*own.columns)
    return done.withColumnsRenamed({new: old for old, new in aside.items()})


def keep_good(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the quality rules reject, by themselves or with their host, go; so do null and empty texts, which are too short."""
    return _applied(docs, quality_rules.keep_good)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Lines that a smaller doc_id has go; documents stay, even those with no line left."""
    return _applied(docs, line_dedup.dedup_lines)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard similarity of 0.8 or more that of the smallest doc_id stays; candidates come from SimHash."""
    return _applied(docs, similar.drop_similar)


def redact_secrets(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Every found secret becomes [SECRET]; overlapping ones become one."""
    return _applied(docs, lambda own: secret_scan.redact_secrets(secret_scan.scan_secrets(own)))


def pack(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, *packing.public_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the similarity stage nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, directory), name)
    return STAGES[-1][1](spark, docs, directory)
