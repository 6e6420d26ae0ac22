"""Further classifications of error messages, each a table of words and labels.

A rung is (words, label): the first rung of which any word occurs in the lower-cased message
gives the label. A word with ``&`` needs all its parts. Empty and null messages have a label of
their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.rules import contains_any, quote

# Ladders by name: rungs, label of anything else, label of no message.
LADDERS = {
    "probe": (
        (
            (("nodename nor servname", "name or service not known", "getaddrinfo failed", "dns", "resolve"), "dns_error"),
            (("connection refused", "errno 111", "errno 61"), "connection_refused"),
            (("timeout", "timed out", "time out"), "connection_timeout"),
            (("connection reset", "broken pipe", "connection aborted"), "connection_refused"),
            (("ssl", "certificate", "cert", "handshake"), "ssl_error"),
            (("redirect", "too many", "47"), "too_many_redirects"),
        ),
        "unknown",
        "unknown",
    ),
    "subpage": (
        ((("timeout",), "timeout"), (("cloudflare",), "cloudflare"), (("soft 404", "empty"), "empty_content")),
        "scrape_fail",
        "unknown",
    ),
    "scraper": (
        (
            (("timeout",), "timeout"),
            (("cloudflare",), "cloudflare"),
            (("403", "waf"), "waf"),
            (("captcha",), "captcha"),
            (("rate&limit",), "rate_limit"),
            (("empty", "404"), "empty_content"),
            (("ssl", "certificate"), "ssl_error"),
            (("dns", "resolve"), "dns_error"),
            (("connection", "connect"), "connection_error"),
        ),
        "unknown",
        "unknown",
    ),
    "transport": (
        (
            (("timeout", "timed out"), "proxy_timeout"),
            (("connect", "refused"), "proxy_connection_error"),
            (("ssl",), "ssl_error"),
        ),
        "other",
        "other",
    ),
    "stress": (
        (
            (("timeout", "timed out"), "timeout"),
            (("connect", "refused", "reset", "broken pipe"), "connection_error"),
            (("ssl", "certificate"), "ssl_error"),
            (("dns", "resolve"), "dns_error"),
            (("proxy",), "proxy_error"),
            (("too many redirect",), "redirect_loop"),
            (("payload", "encoding"), "payload_error"),
        ),
        "other",
        "other",
    ),
    "request": (((("timeout", "timed out"), "timeout"), (("connect", "refused"), "connection"), (("ssl",), "ssl")), "other", "other"),
}
# Probe errors worth another try, and which of several errors is told.
RETRYABLE = ("connection_timeout", "connection_refused", "unknown", "blocked")
ERROR_PRIORITY = (
    "dns_error", "ssl_error", "connection_refused", "connection_timeout", "too_many_redirects", "blocked", "server_error", "http_error", "unknown",
)


def label(message: Column, name: str) -> Column:
    rungs, other, none = LADDERS[name]
    low = F.lower(message)
    out = F.when(message.isNull() | (message == ""), none)
    for words, found in rungs:
        tests = [reduce(lambda a, b: a & b, [contains_any(low, (part,)) for part in w.split("&")]) for w in words if "&" in w]
        plain = tuple(w for w in words if "&" not in w)
        out = out.when(reduce(lambda a, b: a | b, tests + ([contains_any(low, plain)] if plain else [])), found)
    return out.otherwise(other)


def label_sql(message: str, name: str) -> str:
    rungs, other, none = LADDERS[name]
    test = lambda w: "(" + " AND ".join(f"contains(lower({message}), {quote(p)})" for p in w.split("&")) + ")"
    steps = " ".join(f"WHEN {' OR '.join(map(test, words))} THEN '{found}'" for words, found in rungs)
    return f"CASE WHEN {message} IS NULL OR {message} = '' THEN '{none}' {steps} ELSE '{other}' END"


def is_retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def error_rank(kind: Column) -> Column:
    """Place of a probe error in the order in which errors are told; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ERROR_PRIORITY)), kind), F.lit(0)), F.lit(99))


def charset(content_type: Column, head: Column) -> Column:
    """Character set by header, else by a meta tag, else utf-8."""
    named = F.trim(F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), "charset=([^;]*)", 1))
    meta = F.regexp_extract(F.substring(F.coalesce(head, F.lit("")), 1, 2048), r"""(?i)<meta[^>]+charset=["']?([A-Za-z0-9_\-]+)""", 1)
    return F.when(named != "", named).when(meta != "", meta).otherwise("utf-8")


def versioned_base_url(url: Column) -> Column:
    """A model endpoint's base URL, ending in /v1."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(F.endswith(url, F.lit("/v1")), url).when(F.endswith(url, F.lit("/")), F.concat(url, F.lit("v1"))).otherwise(F.concat(url, F.lit("/v1")))


def normal_prompt(text: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")
