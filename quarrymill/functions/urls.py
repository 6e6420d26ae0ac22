"""URL parts and link resolution as column expressions.

Parts come from regular expressions rather than ``parse_url``, which raises on odd input and
drops ports; an absent part is the empty string, and null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME, 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_dots(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` segments resolved; always absolute."""
    done = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.array_append(done, part)),
    )
    joined = F.concat(F.array_join(done, "/"), F.when(path.rlike(r"(?:^|/)\.\.?$"), "/").otherwise(""))
    return F.when(F.contains(path, F.lit(".")) & path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.regexp_replace(F.concat(F.lit("/"), joined), "^/+", "/")).otherwise(path)


def base_parts(base: Column) -> Column:
    """What `resolve_from` needs of a page's URL; as a column it is computed once for all links of a page."""
    folder = F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), "[^/]*$", ""))
    bare = F.regexp_replace(base, "[?#].*$", "")
    return F.struct(base.alias("url"), bare.alias("bare"), folder.alias("folder"), origin(base).alias("origin"), scheme(base).alias("scheme"))


def resolve_from(at: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on the page of `base_parts`, as RFC 3986 has it; absolute ones stay as written."""
    own, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "[?#].*$", 0)
    return (
        F.when(href == "", at["url"])
        .when(F.startswith(href, F.lit("//")), F.concat(at["scheme"], F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(at["origin"], without_dots(own), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(at["bare"], href))
        .when(F.startswith(href, F.lit("#")), F.concat(without_fragment(at["url"]), href))
        .when(href.rlike(SCHEME), href)
        .otherwise(F.concat(at["origin"], without_dots(F.regexp_replace(F.concat(at["folder"], own), "/{2,}", "/")), rest))
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of one ``href`` seen on page ``base``."""
    return resolve_from(base_parts(base), href)
