"""Predicates on fetched pages and text taken from HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.rules import contains_any

# A page under so many characters is no success; longer texts are never a soft 404.
MIN_CONTENT, SOFT_404_MOST, SHORT_404 = 100, 1000, 200
# Marks of a challenge page, besides the word cloudflare.
CHALLENGE_MARKS = ("just a moment...", "cf-browser-verification", "challenge-running", "cf_chl_opt", "checking your browser")
# Words of error pages.
NOT_FOUND_WORDS = (
    "404 not found", "page not found", "página não encontrada", "erro 404", "não encontramos a página", "página inexistente",
    "ops! página não encontrada", "error 404", "file not found",
)
# Elements whose content is no text of the page.
HIDDEN_TAGS = ("script", "style", "noscript", "iframe", "svg", "path", "defs", "symbol", "use")
# Words of a rejection by the site.
REJECTION_WORDS = ("403", "429", "cloudflare", "captcha", "waf", "forbidden", "blocked")


def page_ok(content: Column, error: Column) -> Column:
    return F.coalesce((F.char_length(content) >= MIN_CONTENT) & (F.coalesce(error, F.lit("")) == ""), F.lit(False))


def is_challenge(content: Column) -> Column:
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.contains(low, F.lit("cloudflare")) & contains_any(low, CHALLENGE_MARKS)


def is_soft_404(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    short = (F.char_length(low) < SHORT_404) & F.contains(low, F.lit("not found"))
    return (F.char_length(low) <= SOFT_404_MOST) & (contains_any(low, NOT_FOUND_WORDS) | short)


def is_rejection(error: Column) -> Column:
    return contains_any(F.lower(F.coalesce(error, F.lit(""))), REJECTION_WORDS)


def is_pdf(content_type: Column, body: Column) -> Column:
    named = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    return named | F.coalesce(F.substring(body, 1, 5) == "%PDF-", F.lit(False))


#: Entities that the expressions decode, ampersand last; a page with others needs the parser.
PLAIN_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
OTHER_ENTITY = "&(?!(?:" + "|".join(entity[1:-1] for entity, _ in PLAIN_ENTITIES) + ");)[#A-Za-z0-9]+"


def unescape_html(text: Column) -> Column:
    for entity, char in PLAIN_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Visible text: hidden elements and comments go, tags part lines, lines are stripped, empty ones go."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in HIDDEN_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    parts = F.split(F.regexp_replace(out, r"<[^>]*>", "\n"), "\n", -1)
    lines = F.filter(F.transform(parts, lambda p: F.regexp_replace(unescape_html(p), r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return F.array_join(lines, "\n")
