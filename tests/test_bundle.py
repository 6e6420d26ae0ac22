"""Normalised profiles and their merge against plain dictionaries."""

import json
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import bundle, folds, normal

EMPTY = {s: {f: None for f in fields} for s, fields in normal.PROFILE.items()}
LISTS = [("team", "key_roles"), ("team", "team_certifications"), *[("offerings", f) for f in ("products", "services", "engagement_models", "key_differentiators")], ("offerings", "product_categories"), ("offerings", "service_details"), *[("reputation", f) for f in ("certifications", "awards", "partnerships", "client_list", "case_studies")], *[("contact", f) for f in ("emails", "phones", "locations")]]


def normal_of(spark, answers):
    rows = spark.createDataFrame(list(enumerate(answers)), "k int, body string")
    found = normal.normal_profiles(rows, "body")
    return [json.loads(r.j) for r in found.select("k", normal.profile_json(found).alias("j")).orderBy("k").collect()]


def test_every_shape_of_an_answer(spark):
    answer = {
        "identity": {"company_name": "A", "founding_year": 1999, "tagline": ["x"], "description": "  ", "cnpj": True},
        "team": {"key_roles": " one ", "team_certifications": [1, None, " a ", "a", {"x": 1}, ""], "size_range": 12.5},
        "offerings": {
            "products": "no list", "services": ["s", 3, "s"], "engagement_models": None,
            "product_categories": [{"category_name": "c", "items": ["i", " ", 2]}, {"category_name": ""}, {"category_name": 3}, "bad", None, {"category_name": "d", "items": "x"}],
            "service_details": [{"name": "n", "deliverables": None, "description": 4}, {"name": None}, 7],
        },
        "reputation": {
            "certifications": [{"title": "T"}, {"name": "", "award": "W"}, {"other": "z"}, "s ", None, 4], "awards": "one", "client_list": {"name": "no"},
            "case_studies": [{"challenge": "c" * 60}, {}, {"outcome": "o"}, "x", {"title": "t"}, {"title": " ", "client_name": "me"}],
        },
        "contact": {"website_url": ["ftp://a", 5, "http://b "], "linkedin_url": "https://LinkedIn.com/x", "emails": "e@f.g", "phones": [None], "headquarters_address": ["a", 2]},
        "sources": ["u", 1, "u"],
    }
    want = json.loads(json.dumps(EMPTY)) | {"sources": ["u"]}
    for section, field in LISTS:
        want[section][field] = []
    want["identity"] |= {"company_name": "A", "founding_year": "1999", "cnpj": "true"}
    want["team"] |= {"key_roles": ["one"], "team_certifications": ["a"], "size_range": "12.5"}
    detail = {"name": "n", "description": "4", "methodology": None, "ideal_client_profile": None, "deliverables": []}
    want["offerings"] |= {"services": ["s"], "product_categories": [{"category_name": "c", "items": ["i"]}, {"category_name": "d", "items": []}], "service_details": [detail]}
    case = dict.fromkeys(("title", "client_name", "industry", "challenge", "solution", "outcome"))
    cases = [case | {"title": f"Desafio: {'c' * 50}...", "challenge": "c" * 60}, case | {"title": normal.UNTITLED, "outcome": "o"}, case | {"title": "t"}, case | {"title": "Caso: me", "client_name": "me"}]
    want["reputation"] |= {"certifications": ["T", "W", "s"], "awards": ["one"], "case_studies": cases}
    want["contact"] |= {"website_url": "http://b", "linkedin_url": "https://LinkedIn.com/x", "emails": ["e@f.g"], "headquarters_address": "a"}
    nothing = json.loads(json.dumps(EMPTY)) | {"sources": []}
    for section, field in LISTS:
        nothing[section][field] = []
    odd = ["[]", "[3]", "no json", "", None, "5", "null", '"text"', "{}", '{"team": [], "identity": 3, "offerings": null, "contact": "x"}']
    got = normal_of(spark, [json.dumps(answer), json.dumps([answer, 2]), *odd])
    assert got == [want, want, *[nothing] * len(odd)]


def more(current, new, joined):
    if not current or not new:
        return current or new
    return folds.tell_more(current, new) if joined else (new if len(new) > len(current) else current)


def merged_plainly(rows):
    """One company's merged profile by dictionaries, profile after profile."""

    def score(p):
        size = lambda v: len(v) // 10 if isinstance(v, str) else len(v or [])
        return sum(size(v) for section in normal.PROFILE for v in p[section].values()) + len(p["sources"])

    base = min(rows, key=lambda r: (-score(r[1]), r[0]))
    ordered = [base[1], *[p for k, p in sorted(rows, key=lambda r: r[0]) if k != base[0]]]
    out = {"sources": list(dict.fromkeys(x for p in ordered for x in p["sources"]))}
    for section, fields in normal.PROFILE.items():
        out[section] = {}
        for field in fields:
            values = [p[section][field] for p in ordered]
            if (section, field) not in LISTS:
                out[section][field] = reduce(lambda a, b: more(a, b, field in ("tagline", "description")), values)
            elif section in ("team", "contact"):
                out[section][field] = next((v for v in values if v), [])
            elif field not in ("product_categories", "service_details", "case_studies"):
                out[section][field] = list(dict.fromkeys(x for v in values for x in v))
            else:
                name = {"product_categories": "category_name", "service_details": "name", "case_studies": "title"}[field]
                kept = [e for i, e in enumerate(values[0]) if all(e[name] != later[name] for later in values[0][i + 1 :])]
                entries = {}
                for e in [*kept, *[e for v in values[1:] for e in v]]:
                    if field == "product_categories" and e[name].strip().lower() in ("geral", "outros"):
                        continue
                    old = entries.setdefault(e[name], {k: [] if isinstance(v, list) else None for k, v in e.items()} | {name: e[name]})
                    for k, v in e.items():
                        if isinstance(v, list):
                            old[k] = list(dict.fromkeys(old[k] + v))
                        elif k != name:
                            old[k] = more(old[k], v, k in ("description", "methodology"))
                out[section][field] = list(entries.values())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_dictionaries(spark, seed):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(rng.randrange(1, 6)))
    some = lambda make, most: [make() for _ in range(rng.randrange(most))]

    def answer():
        out = {s: {f: some(say, 3) if (s, f) in LISTS else rng.choice([None, say()]) for f in fields} for s, fields in normal.PROFILE.items()}
        name = lambda: rng.choice(["A", "B", "Geral", "C d"])
        out["offerings"]["product_categories"] = some(lambda: {"category_name": name(), "items": some(say, 3)}, 4)
        out["offerings"]["service_details"] = some(lambda: {"name": name(), "description": rng.choice([None, say()]), "methodology": say(), "ideal_client_profile": rng.choice([None, say()]), "deliverables": some(say, 3)}, 4)
        out["reputation"]["case_studies"] = some(lambda: {f: say() for f in ("title", "client_name", "industry", "challenge", "solution", "outcome")} | {"title": name()}, 4)
        out["contact"] |= {"website_url": rng.choice([None, f"http://{say().replace(' ', '')}"]), "linkedin_url": None}
        return out | {"sources": some(say, 3)}

    rows = [(n % 7, n * 31 % 1000, json.dumps(answer())) for n in range(60)] + [(99, 1, "[]")]
    profiles = normal.normal_profiles(spark.createDataFrame(rows, "company long, chunk long, body string"), "body")
    parsed = profiles.select("company", "chunk", normal.profile_json(profiles).alias("j")).collect()
    got = {r.company: json.loads(r.profile_json) for r in bundle.merged_json(profiles).collect()}
    for company in {r[0] for r in rows}:
        assert got[company] == merged_plainly([(r.chunk, json.loads(r.j)) for r in parsed if r.company == company])
    assert bundle.merged_profiles(profiles.where("company < 0")).count() == 0


def test_fold_carries_on_across_batches(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d e f g h i j k l m n o p".split()) for _ in range(4)) for _ in range(3000)]
    rows = spark.createDataFrame([(n % 3 // 2, n, rng.choice([None, "", t]) if n % 5 else t) for n, t in enumerate(texts)], "key int, n int, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {r.key: r.t for r in folds.folded_texts(rows, ["key"], ["n"], ["t"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = rows.orderBy("n").collect()
    assert got == {key: reduce(folds.tell_more, [r.t for r in kept if r.key == key]) or None for key in (0, 1)}


def test_a_company_of_a_million_texts(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("key"), "id", F.when(F.col("id") % 7 == 0, F.lit("told again and again")).otherwise(F.lit("again and")).alias("t"))
    assert [tuple(r) for r in folds.folded_texts(rows, ["key"], ["id"], ["t"]).collect()] == [(1, "told again and again")]
