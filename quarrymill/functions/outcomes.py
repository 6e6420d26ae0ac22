"""Labels for errors and failed fetches: ladders generated from tables of fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.rules import contains_any, ladder, sql_contains_any

# Words of errors that may pass by themselves.
TRANSIENT_WORDS = (
    "timeout", "429", "rate limit", "connection reset", "connection refused", "connection error", "temporarily",
    "server error", "502", "503", "504",
)

# Error categories by words, the first that matches counts.
ERROR_CATEGORIES = {
    "dns": ("dns", "resolve", "name resolution"),
    "timeout": ("timeout", "timed out"),
    "connection": ("connection reset", "connection refused", "connection error", "connect"),
    "ssl": ("ssl", "certificate"),
    "cloudflare": ("cloudflare", "challenge"),
    "captcha": ("captcha",),
    "rate_limit": ("429", "rate limit", "too many"),
    "empty_content": ("nenhum conteudo", "empty", "soft 404", "insuficiente"),
    "server_error": ("502", "503", "504", "server error"),
    "blocked": ("403", "forbidden", "blocked"),
}

# Buckets of failure reasons: (scope, words any of which must occur, word that must not, bucket).
# Scope: probe = starts with probe_, proxy = contains proxy_fail, any = neither.
REASON_BUCKETS = (
    ("probe", ("dns",), None, "probe:dns"),
    ("probe", ("connection_timeout",), None, "probe:timeout"),
    ("probe", ("timeout",), "concurrency", "probe:timeout"),
    ("probe", ("refused", "reset"), None, "probe:refused"),
    ("probe", ("ssl",), None, "probe:ssl"),
    ("probe", ("blocked", "403"), None, "probe:blocked"),
    ("probe", ("server_error", "500"), None, "probe:server_error"),
    ("probe", ("redirect",), None, "probe:redirect_loop"),
    ("probe", (), None, "probe:other"),
    ("proxy", ("proxy_timeout", "timed out"), None, "proxy:timeout"),
    ("proxy", ("proxy_connection", "refused"), None, "proxy:connection"),
    ("proxy", ("http_403",), None, "proxy:http_403"),
    ("proxy", ("http_5",), None, "proxy:http_5xx"),
    ("proxy", ("ssl",), None, "proxy:ssl"),
    ("proxy", ("empty_response",), None, "proxy:empty_response"),
    ("proxy", (), None, "proxy:other"),
    ("blocked", ("cloudflare",), None, "scrape:blocked_cloudflare"),
    ("blocked", (), None, "scrape:blocked_waf"),
    ("any", ("soft 404", "soft_404"), None, "scrape:soft_404"),
    ("any", ("cloudflare",), None, "scrape:cloudflare"),
    ("any", ("timeout",), None, "scrape:timeout"),
    ("any", ("thin_content",), None, "scrape:thin_content"),
    ("any", ("empty_content",), None, "scrape:empty_content"),
    ("any", ("scrape_error",), None, "scrape:error"),
    ("any", ("scrape_null",), None, "scrape:null_response"),
)

# What kind of failure a bucket is; others are "other".
BUCKET_KINDS = {
    "probe:dns": "site_offline", "probe:refused": "site_offline", "probe:server_error": "site_offline",
    "probe:redirect_loop": "site_offline", "probe:timeout": "proxy_infra", "probe:ssl": "site_offline",
    "probe:other": "proxy_infra", "probe:blocked": "blocked", "proxy:timeout": "proxy_infra",
    "proxy:connection": "proxy_infra", "proxy:ssl": "proxy_infra", "proxy:empty_response": "proxy_infra",
    "proxy:other": "proxy_infra", "proxy:http_403": "blocked", "proxy:http_5xx": "site_offline",
    "scrape:blocked_waf": "blocked", "scrape:blocked_cloudflare": "blocked", "scrape:cloudflare": "blocked",
    "scrape:soft_404": "content_issue", "scrape:thin_content": "content_issue", "scrape:empty_content": "content_issue",
    "scrape:error": "other", "scrape:null_response": "other", "scrape:timeout": "proxy_infra",
}


def is_transient(message: Column) -> Column:
    return contains_any(F.lower(message), TRANSIENT_WORDS)


def error_category(message: Column) -> Column:
    low = F.lower(message)
    steps = [(message.isNull() | (message == ""), "unknown")]
    return ladder(message, steps + [(contains_any(low, words), name) for name, words in ERROR_CATEGORIES.items()], "other")


def error_category_sql(message: str) -> str:
    steps = " ".join(f"WHEN {sql_contains_any(f'lower({message})', words)} THEN '{name}'" for name, words in ERROR_CATEGORIES.items())
    return f"CASE WHEN {message} IS NULL OR {message} = '' THEN 'unknown' {steps} ELSE 'other' END"


def reason_bucket(reason: Column) -> Column:
    low = F.lower(reason)
    scopes = {"probe": F.startswith(low, F.lit("probe_")), "proxy": F.contains(low, F.lit("proxy_fail")), "blocked": F.contains(low, F.lit("blocked"))}
    out = F.when(reason.isNull() | (reason == ""), "unknown")
    for scope, words, without, bucket in REASON_BUCKETS:
        test = scopes.get(scope, F.lit(True))
        if words:
            test &= contains_any(low, words)
        if without:
            test &= ~F.contains(low, F.lit(without))
        out = out.when(test, bucket)
    return out.otherwise(F.concat(F.lit("other:"), F.substring(reason, 1, 30)))


def reason_bucket_sql(reason: str) -> str:
    scopes = {"probe": f"prefix(lower({reason}), 'probe_')", "proxy": f"contains(lower({reason}), 'proxy_fail')", "blocked": f"contains(lower({reason}), 'blocked')"}
    out = f"CASE WHEN {reason} IS NULL OR {reason} = '' THEN 'unknown' "
    for scope, words, without, bucket in REASON_BUCKETS:
        tests = [scopes.get(scope, "true")]
        if words:
            tests.append(sql_contains_any(f"lower({reason})", words))
        if without:
            tests.append(f"NOT contains(lower({reason}), '{without}')")
        out += f"WHEN {' AND '.join(tests)} THEN '{bucket}' "
    return out + f"ELSE 'other:' || substr({reason}, 1, 30) END"


def bucket_kind(bucket: Column) -> Column:
    kinds: dict[str, list[str]] = {}
    for name, kind in BUCKET_KINDS.items():
        kinds.setdefault(kind, []).append(name)
    return ladder(bucket, [(bucket.isin(names), kind) for kind, names in kinds.items()], "other")


def bucket_kind_sql(bucket: str) -> str:
    return f"CASE {bucket} " + " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in BUCKET_KINDS.items()) + " ELSE 'other' END"
