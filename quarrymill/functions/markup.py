"""Tags and attributes of HTML as column expressions: a tokenizer that stays in the JVM.

One expression yields the tags of a page and their attributes in order. ``\\G`` chains each
attribute to the end of the token before it, so quotes hold whatever they hold (``>``, ``<a``),
names may be in any case and values in double quotes, single quotes, bare or absent, as an HTML
parser reads them. No group repeats, so long tags cost no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, declarations, and elements whose content is no markup; what is never closed goes to the end.
RAW_TEXT = "|".join(rf"<(?i:{name})\b[^>]*>.*?(?:</(?i:{name})(?=[\s/>])[^>]*>|\z)" for name in ("script", "style"))
NO_MARKUP = rf"(?s)<!--.*?(?:--\s*>|\z)|<[!?][^>]*>|{RAW_TEXT}"
NAME = r"[^\s/>][^\s/>=]*+"
VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
#: A tag's start, or its next attribute.
TOKEN = rf"<[A-Za-z][^\s/>]*+|\G(?!\A)[\s/]*+{NAME}(?:\s*+=+\s*+{VALUE})?+"
SEPARATOR = "\x01"
#: References that are read here; what else looks like one, as an attribute would have it, needs the full table.
KNOWN = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&amp;": "&"}
OTHER_REFERENCE = r"&(?!(?:lt|gt|quot|apos|amp|#39|#x27);)(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]*;|[A-Za-z]{2,}[0-9]*(?![A-Za-z0-9=]))"


def without_raw_text(html: Column) -> Column:
    """The page without comments and raw text; make it a column of its own, so that it is computed once."""
    return F.regexp_replace(F.translate(html, SEPARATOR, " "), NO_MARKUP, " ")


def tags(body: Column, name: str) -> Column:
    """Each tag of that name in `without_raw_text` as a string: ``<name``, then its attributes, parted by SEPARATOR.

    Null gives null. A tag that the page's end cuts off is none.
    """
    whole = F.left(body, F.char_length(body) - F.char_length(F.substring_index(body, ">", -1)))
    tokens = F.array_join(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), SEPARATOR)
    return F.filter(F.split(tokens, f"{SEPARATOR}(?=<[A-Za-z])"), lambda tag: tag.rlike(f"(?i)^<{name}(?:{SEPARATOR}|$)"))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, the last one if repeated; empty without a value, null without it."""
    own = F.filter(F.split(tag, SEPARATOR), lambda token: token.rlike(rf"(?i)^[\s/]*+{name}(?:\s*+=|$)"))
    value = F.regexp_replace(F.try_element_at(own, F.lit(-1)), rf"(?s)^[\s/]*+{NAME}(?:\s*+=+\s*+)?+", "")
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def decoded(value: Column) -> Column:
    """``value`` with the known references replaced."""
    plain = value
    for reference, text in KNOWN.items():
        plain = F.replace(plain, F.lit(reference), F.lit(text))
    return F.when(F.contains(value, F.lit("&")), plain).otherwise(value)
