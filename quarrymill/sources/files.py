"""File sources and sinks: JSON reports, chunk tables, debug dumps, bytes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import ladders
from quarrymill.functions.text import EFFECTIVE_MAX_TOKENS
from quarrymill.staging import with_position

# Names of charsets that the JVM knows by another one; others that it knows.
CHARSET_NAMES = {"iso8859-1": "iso-8859-1", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "cp1252": "windows-1252"}
CHARSETS = ("us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")

CHUNKS = "key string, discovery_id long, website_url string, chunk_index int, total_chunks int, chunk_content string, token_count int, page_source string, error string"


def read_report(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """Rows of JSON files that hold one array of objects each, or, unless ``whole``, an object on each line."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Appends chunk and error rows; a job's rows appear all at once or not at all.

    Rows are written as they are partitioned, so a large batch needs no further shuffle.
    """
    chunks.select(*[F.col(part.split()[0]).cast(part.split()[1]) for part in CHUNKS.split(", ")]).write.mode("append").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def dump_chunks(chunks: DataFrame, path: str) -> None:
    """Debug copy, one folder per key, with the flag of chunks over the limit."""
    chunks.withColumn("exceeds_limit", F.col("token_count") > EFFECTIVE_MAX_TOKENS).write.mode("overwrite").partitionBy("key").json(path)


def with_row_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with row_id from 0 in the given order, without a window over the whole table."""
    return with_position(rows, [], [F.col(c) for c in order], "row_id")


def decoded(rows: DataFrame, body: str, content_type: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the text of a page's bytes. PDF gives an empty text.

    The charset is that of the header, else of the markup, else UTF-8. Where the bytes are not
    of that charset, or its name is unknown, UTF-8 is tried, and ISO-8859-1 takes what is left.
    """
    names = F.create_map(*[F.lit(x) for pair in CHARSET_NAMES.items() for x in pair])
    read = rows.withColumn("_latin", F.decode(body, "iso-8859-1"))
    read = read.withColumn("_told", F.lower(ladders.charset(F.col(content_type), F.col("_latin"))))
    read = read.withColumn("_charset", F.coalesce(names[F.col("_told")], "_told"))
    in_utf8 = F.try_validate_utf8(F.col(body).cast("string"))
    by_name = F.when(F.col("_charset") == "utf-8", in_utf8).when(F.col("_charset") == "windows-1252", _windows_1252(F.col("_latin")))
    for charset in CHARSETS:
        by_name = by_name.when(F.col("_charset") == charset, F.decode(body, charset))
    pdf = F.coalesce(F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False)) | F.startswith("_latin", F.lit("%PDF-"))
    text = F.when(pdf, "").otherwise(F.coalesce(by_name, in_utf8, "_latin"))
    return read.withColumn(name, text).drop("_latin", "_told", "_charset")


def _windows_1252(latin: Column) -> Column:
    """Text read as ISO-8859-1, as what windows-1252 has for its control characters; null with bytes that this has not."""
    controls = [chr(n) for n in range(0x80, 0xA0)]
    told = {c: c.encode("latin-1").decode("windows-1252", "ignore") for c in controls}
    known = "".join(c for c in controls if told[c])
    unknown = "".join(c for c in controls if not told[c])
    return F.when(latin == F.translate(latin, unknown, ""), F.translate(latin, known, "".join(told[c] for c in known)))
