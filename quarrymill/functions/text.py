"""Text expressions: normal forms, token estimates, quality counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token estimate and its bounds.
CHARS_PER_TOKEN, SYSTEM_OVERHEAD, MESSAGE_TOKENS, MIN_MESSAGE_TOKENS = 3, 2500, 100, 100
# Effective chunk size, (20000 - 2500 - 200) * 0.85.
EFFECTIVE_MAX_TOKENS = 14705
# Margins by repetition rate and by size, from the strictest bound down.
REPETITION_MARGINS = ((0.90, 0.15), (0.80, 0.10), (0.70, 0.05))
SIZE_MARGINS = ((80000, 0.25), (75000, 0.20), (70000, 0.15), (60000, 0.10), (50000, 0.05))
# Output budgets by input tokens.
OUTPUT_BUDGETS = ((3000, 900), (8000, 1400))
OUTPUT_BUDGET_MOST = 2200
# Words left out of, and plurals undone in, a service label.
SERVICE_STOPWORDS = ("de", "da", "do", "das", "dos")
SERVICE_PLURALS = (("sistemas", "sistema"), ("serviços", "serviço"), ("soluções", "solução"))
# Suffixes of company names, removed wherever they occur, in this order.
COMPANY_SUFFIXES = (" LTDA", " S.A.", " EIRELI", " ME", " EPP", " S/A")


def collapse_spaces(text: Column) -> Column:
    """Runs of white space, of Unicode too, as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def normal_email(text: Column) -> Column:
    return F.lower(F.trim(text))


def normal_url(text: Column) -> Column:
    """Without query, fragment and one closing slash (unless 9 characters or fewer)."""
    bare = F.regexp_replace(F.trim(text), r"(?s)[?#].*$", "")
    return F.when(F.endswith(bare, F.lit("/")) & (F.char_length(bare) > 9), F.substring(bare, F.lit(1), F.char_length(bare) - 1)).otherwise(bare)


def normal_phone(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9+]", "")


def service_label(text: Column) -> Column:
    words = F.filter(F.split(F.lower(collapse_spaces(text)), " "), lambda w: ~w.isin(*SERVICE_STOPWORDS))
    label = F.array_join(words, " ")
    for plural, one in SERVICE_PLURALS:
        label = F.regexp_replace(label, rf"(?U)\b{plural}\b", one)
    return F.trim(label)


def company_base_name(name: Column, end_only: bool = False) -> Column:
    """Without company suffixes: removed anywhere, or only at the end."""
    if end_only:
        return F.trim(F.regexp_replace(name, r"(?: LTDA| S\.A\.| EIRELI| ME| EPP| S/A)+\s*$", ""))
    for suffix in COMPANY_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return F.trim(name)


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / CHARS_PER_TOKEN)


def message_tokens(chars: Column, messages: Column) -> Column:
    return F.greatest(F.lit(MIN_MESSAGE_TOKENS), F.floor(chars / CHARS_PER_TOKEN) + MESSAGE_TOKENS * messages)


def lines_of(text: Column) -> Column:
    """Lines between newlines; a closing newline opens no further line, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def repetition_rate(text: Column) -> Column:
    lines = lines_of(text)
    return F.when(F.size(lines) == 0, 0.0).otherwise((F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines))


def margin_ladder(value: Column, margins: tuple) -> Column:
    out = F.when(F.lit(False), 0.0)
    for bound, margin in margins:
        out = out.when(value > bound, margin)
    return out.otherwise(0.0)


def adjusted_limit(tokens: Column, repetition: Column, base: int) -> Column:
    """The token limit left after the margins; where the text is above it, after the margin that it needs."""
    margin = F.greatest(margin_ladder(repetition, REPETITION_MARGINS), margin_ladder(tokens, SIZE_MARGINS))
    plain = F.floor(base * (1 - margin))
    needed = F.least(1 - tokens / F.lit(float(base)) + 0.05, F.lit(0.30))
    return F.when(tokens > plain, F.floor(base * (1 - needed))).otherwise(plain)


def output_budget(tokens: Column, retry: Column) -> Column:
    budget = F.when(F.lit(False), 0)
    for bound, value in OUTPUT_BUDGETS:
        budget = budget.when(tokens < bound, value)
    budget = budget.otherwise(OUTPUT_BUDGET_MOST)
    return F.when(retry, F.floor(budget * 0.75)).otherwise(budget)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, with a note of the whole length where text was cut."""
    note = F.concat(F.substring(text, 1, most), F.lit("... [truncated, total "), F.char_length(text).cast("string"), F.lit(" chars]"))
    return F.when(F.char_length(text) > most, note).otherwise(text)


def employee_range(text: Column) -> tuple[Column, Column]:
    """(least, most) of a range such as 10-50; nulls for anything else."""
    whole = r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*$"
    part = lambda n: F.when(text.rlike(whole), F.regexp_extract(text, whole, n).try_cast("int"))
    return part(1), part(2)


def display_name(name: Column, tagline: Column, description: Column, key: Column) -> Column:
    """Name, else 100 characters of the tagline, else 50 of the description's first sentence, else the key."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    first = F.substring(F.element_at(F.split(description, r"\."), 1), 1, 50)
    return F.coalesce(filled(name), filled(F.substring(tagline, 1, 100)), filled(first), F.concat(F.lit("Empresa CNPJ "), key))
