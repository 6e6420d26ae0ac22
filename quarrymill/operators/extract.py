"""Structured values out of loose text: JSON in answers, loose shapes, summaries, URL repair."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import outcomes


def balanced_object(text: str | None) -> str | None:
    """The first JSON object of a text, up to the brace that closes it; strings may hold braces."""
    if not text or "{" not in text:
        return None
    start = text.index("{")
    depth, quoted, escaped = 0, False, False
    for at in range(start, len(text)):
        char = text[at]
        if quoted:
            quoted, escaped = escaped or char != '"', char == "\\" and not escaped
        elif char == '"':
            quoted, escaped = True, False
        elif char in "{}":
            depth += 1 if char == "{" else -1
            if not depth:
                return text[start : at + 1]
    return None


#: A comma before a closing bracket; a string in single quotes where JSON wants a double-quoted one.
TRAILING_COMMA = re.compile(r",\s*([}\]])")
SINGLE_QUOTED = re.compile(r"(?<=[{\[,:])\s*'([^'\"]*)'\s*(?=[,:}\]])")


def closed(text: str) -> str:
    """A cut-off object up to its last whole part, with the quotes and brackets that are missing."""
    opened, quoted, escaped = [], False, False
    for char in text:
        if quoted:
            quoted, escaped = escaped or char != '"', char == "\\" and not escaped
        elif char == '"':
            quoted, escaped = True, False
        elif char in "{[":
            opened.append("}" if char == "{" else "]")
        elif char in "}]" and opened:
            opened.pop()
    return text + '"' * quoted + "".join(reversed(opened))


def mended_object(text: str | None) -> str | None:
    """The first object of a text as valid JSON, by the mildest of these that works: as it is, without
    trailing commas and with double quotes, and closed where it is cut off; null if none does."""
    if not text or "{" not in text:
        return None
    whole = balanced_object(text)
    raw = whole or text[text.index("{") :].rstrip()
    plain = SINGLE_QUOTED.sub(r'"\1"', TRAILING_COMMA.sub(r"\1", raw))
    shut = closed(plain)
    for tried in (raw, plain, shut, TRAILING_COMMA.sub(r"\1", shut)):
        try:
            json.loads(tried)
        except ValueError:
            continue
        return tried
    return None


def _mended(texts: pd.Series) -> pd.Series:
    return texts.map(mended_object)


def _some_in_python(rows: DataFrame, name: str, simple: Column, hard: Column, body: Column, function: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``rows`` with ``name``: ``simple``, or where ``hard`` holds ``function`` of ``body``.

    A Python function inside ``when`` would get every row, so the hard rows are a branch of
    their own.
    """
    python = F.pandas_udf(function, "string")
    return rows.where(~hard).withColumn(name, simple).unionByName(rows.where(hard).withColumn(name, python(body)))


def with_json_object(rows: DataFrame, answer: str, name: str = "json") -> DataFrame:
    """``rows`` with JSON text of the object in a model's answer, null without one.

    Fences, words before and after, trailing commas, single quotes around keys and values, and
    missing closing brackets are mended. Where the object ends with the text and is already
    JSON, expressions are enough; only other answers leave the JVM.
    """
    body = F.regexp_replace(F.regexp_replace(answer, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)```.*$", "")
    simple = F.nullif(F.regexp_extract(body, r"(?s)^[^{]*(\{.*\})\s*$", 1), F.lit(""))  # nested objects too
    good = F.coalesce(F.try_parse_json(simple).isNotNull(), F.lit(False))
    hard = F.coalesce(F.contains(body, F.lit("{")) & ~good, F.lit(False))
    return _some_in_python(rows, name, F.when(good, simple), hard, body, _mended)


def as_list(json: Column, field: str) -> Column:
    """A field as a list of strings, be it a list, a scalar or absent; blanks and non-strings go."""
    listed = F.from_json(json, f"{field} array<string>")[field]
    single = F.from_json(json, f"{field} string")[field]
    scalar = F.when(single.isNotNull() & ~F.startswith(single, F.lit("[")), F.array(single))
    return F.filter(F.coalesce(listed, scalar, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def first_object(json: Column) -> Column:
    """A list's first object, or the object itself."""
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), F.get_json_object(json, "$[0]")).otherwise(json)


def thoughts(text: Column, most: int = 5000) -> Column:
    """The bodies of <think> blocks, one per line, cut to ``most`` characters."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))
    return F.substring(F.array_join(F.transform(bodies, lambda b: F.trim(b)), "\n"), 1, most)


def error_summary(reason: Column, pages_ok: Column, attempted: Column, sub_ok: Column, fallback: Column) -> Column:
    """category and resumo of a failed scrape, as a struct that ``to_json`` writes."""
    bucket = F.when(reason.isNotNull(), outcomes.reason_bucket(reason))
    told = (
        F.when(reason.isNotNull(), F.concat(F.lit("Main page falhou: "), bucket))
        .when(pages_ok == 0, "Main page ok mas conteúdo insuficiente")
        .when(
            attempted > 0,
            F.concat(F.lit("Main ok, "), pages_ok.cast("string"), F.lit(" páginas ok, "), (attempted - sub_ok).cast("string"), F.lit("/"), attempted.cast("string"), F.lit(" subpages falharam")),
        )
        .otherwise(F.coalesce(fallback, F.lit("Erro desconhecido")))
    )
    return F.struct(F.coalesce(bucket, outcomes.error_category(fallback)).alias("error_category"), told.alias("resumo"))


def repaired_url(url: str | None) -> str | None:
    """A URL without outer quotes and commas, cut at an encoded quote, path and query percent-encoded."""
    if url is None:
        return None
    text = url.strip().rstrip(",")
    for mark in "\"'":
        if len(text) > 1 and text[0] == text[-1] == mark:
            text = text[1:-1]
    text = text.strip().rstrip(",")
    parts = urlsplit(text)
    path, query = (value.split("%20%22")[0].split("%22")[0] for value in (parts.path, parts.query))
    if "%" not in path:
        path = quote(path, safe="/")
    if "%" not in query:
        query = "&".join(_pair(part) for part in query.split("&"))
    return f"{parts.scheme}://{parts.netloc}{path}" + (f"?{query}" if query else "")


def _pair(part: str) -> str:
    key, sign, value = part.partition("=")
    return quote(key, safe="") + sign + quote(value, safe="")


def _repaired(urls: pd.Series) -> pd.Series:
    return urls.map(repaired_url)


#: URLs that the repair would leave as they are.
CLEAN_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\"',%\s]+(/[A-Za-z0-9_.\-~]*)*(\?[A-Za-z0-9_.\-~]+=[A-Za-z0-9_.\-~]*(&[A-Za-z0-9_.\-~]+=[A-Za-z0-9_.\-~]*)*)?$"


def with_repaired(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` with ``url`` as ``repaired_url`` gives it; clean URLs never leave the JVM."""
    raw = rows.withColumnRenamed(url, "_url")
    hard = F.coalesce(~F.col("_url").rlike(CLEAN_URL), F.lit(False))
    return _some_in_python(raw, url, F.col("_url"), hard, F.col("_url"), _repaired).drop("_url")


def merged_counters(parts: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of instances added up, as from one instance."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])
