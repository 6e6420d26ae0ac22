"""Finding a company's site: search queries, blacklists, result filters, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import urls
from quarrymill.functions.text import company_base_name

# Domains that are never a company's own site.
BLACKLIST = (
    "econodata.com.br", "cnpj.biz", "cnpja.com", "cnpj.info", "cnpjs.rocks", "casadosdados.com.br", "empresascnpj.com",
    "consultacnpj.com", "informecadastral.com.br", "cadastroempresa.com.br", "transparencia.cc", "listamais.com.br",
    "solutudo.com.br", "telelistas.net", "apontador.com.br", "guiamais.com.br", "construtora.net.br", "b2bleads.com.br",
    "empresas.serasaexperian.com.br", "jusbrasil.com.br", "jusdados.com",
    "facebook.com", "instagram.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "tiktok.com", "pinterest.com", "threads.net",
    "mercadolivre.com.br", "shopee.com.br", "olx.com.br", "amazon.com.br", "magazineluiza.com.br", "americanas.com.br",
    "translate.google.com", "webcache.googleusercontent.com",
)


def host_of(url: Column) -> Column:
    """Lower-case host with www., m. and mobile. taken off in turn; a url without scheme counts as https."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(urls.netloc(full))
    for prefix in ("www\\.", "m\\.", "mobile\\."):
        host = F.regexp_replace(host, f"^{prefix}", "")
    return host


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(F.split(host, r"\."), i, F.lit(1000)), "."))


def without_blacklisted(rows: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """``rows`` whose host is no listed domain and lies in none; ``domains`` has column domain.

    Exploding a host's few suffixes makes it an equality anti join, which no list makes slow.
    """
    hosts = rows.select(F.col(url).alias("_url")).distinct().select("_url", F.explode(host_suffixes(host_of(F.col("_url")))).alias("domain"))
    bad = hosts.join(domains.select("domain"), "domain", "left_semi").select("_url").distinct()
    return rows.join(bad, rows[url] == bad["_url"], "left_anti")


def search_results(rows: DataFrame) -> DataFrame:
    """id, position, title, link, snippet of JSON search responses (column json): the organic list."""
    shape = "organic array<struct<title: string, link: string, snippet: string>>"
    organic = F.from_json("json", shape)["organic"]
    return rows.select("id", F.posexplode(organic).alias("position", "r")).select("id", "position", "r.*")


def first_of_each_link(results: DataFrame) -> DataFrame:
    """The first result of each link of an id."""
    order = Window.partitionBy("id", "link").orderBy("position")
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


#: Fixed value: what a query asks for.
ASKED = "site oficial"


def _asked(*parts: Column) -> Column:
    """The parts that are not blank and what is asked for, in one string."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts], F.lit(ASKED))


def _names(name: Column, trade_name: Column, city: Column) -> tuple[Column, Column, Column]:
    """Trade name, company name without suffixes, and city; blank where absent."""
    trade, full, place = (F.trim(F.coalesce(c, F.lit(""))) for c in (trade_name, name, city))
    return trade, company_base_name(full), place


def search_queries(name: Column, trade_name: Column, city: Column) -> Column:
    """Queries by trade name and by company name, unless the two are equal but for case; null city as blank."""
    names = _names(name, trade_name, city)
    distinct = F.filter(F.array(*names[:2]), lambda n: n != "")
    distinct = F.when(F.upper(names[0]) == F.upper(names[1]), F.slice(distinct, 1, 1)).otherwise(distinct)
    return F.transform(distinct, lambda n: _asked(n, names[2]))


def search_query(name: Column, trade_name: Column, city: Column) -> Column:
    """The first of ``search_queries``; by city alone, or by nothing, where there is no name."""
    place = _names(name, trade_name, city)[2]
    bare = F.concat_ws(" ", F.lit(ASKED), F.nullif(place, F.lit("")))
    return F.coalesce(F.get(search_queries(name, trade_name, city), 0), bare)


def site_decision(response: Column) -> Column:
    """The site of a model's JSON answer: only where it says sim and gives a real url; null otherwise."""
    body = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    answer = F.from_json(body, "site string, site_oficial string")
    good = (F.lower(F.trim(answer["site_oficial"])) == "sim") & answer["site"].rlike("^https?://")
    return F.when(good, F.trim(answer["site"]))


def chosen_links(links: Column, answer: Column) -> Column:
    """Links at the 1-based places that a model's answer lists, in its order; others are dropped.

    The answer is a JSON list, or an object with one under links, selected or indices, or else under its first name.
    """
    lists = F.coalesce(
        F.from_json(answer, "array<int>"),
        *[F.from_json(answer, f"{key} array<int>")[key] for key in ("links", "selected", "indices")],
        F.get(F.map_values(F.from_json(answer, "map<string, array<int>>")), 0),
        F.array().cast("array<int>"),
    )
    ordered = F.array_sort(links)
    return F.transform(F.filter(lists, lambda i: (i >= 1) & (i <= F.size(links))), lambda i: F.get(ordered, i - 1))


def url_variations(url: Column) -> Column:
    """https and http, with and without www., and the url as given; https first, then www first."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme, host, path = urls.scheme(full), urls.netloc(full), urls.path(full)
    base = F.replace(host, F.lit("www."), F.lit(""))
    bare = lambda s, h: F.regexp_replace(F.concat(s, F.lit("://"), h, path), "/+$", "")
    every = F.array(*[bare(F.lit(s), F.concat(F.lit(p), base)) for s in ("https", "http") for p in ("www.", "")], bare(scheme, host))
    keyed = F.transform(
        F.array_distinct(every), lambda u: F.struct((~F.startswith(u, F.lit("https"))).alias("a"), (~F.contains(u, F.lit("www."))).alias("b"), u.alias("u"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["u"])
