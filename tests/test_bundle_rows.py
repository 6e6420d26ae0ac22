"""Companies' rows of the merge hold codes: profiles and texts don't travel with them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import bundle, folds, normal
from quarrymill.plans import bundles
from quarrymill.session import table
from quarrymill.staging import in_buckets


def given_to(monkeypatch, module, name, run):
    """What ``run`` hands to a function as its first argument."""
    given, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda first, *rest, **named: given.append(first) or real(first, *rest, **named))
    run()
    return given


def test_a_part_is_one_profile_for_all_its_suppliers(spark, small_dir, monkeypatch):
    (profiles,) = given_to(monkeypatch, bundle, "merged_profiles", lambda: bundles.merged_bundles(spark, small_dir))
    assert profiles.count() == table(spark, small_dir, "lineitem").select("l_partkey").distinct().count()


def test_rows_that_meet_by_company_hold_numbers(spark, small_dir, monkeypatch):
    (rows,) = given_to(monkeypatch, bundle, "in_buckets", lambda: bundles.merged_bundles(spark, small_dir))
    assert {f.dataType.simpleString() for f in rows.schema} == {"bigint"}


def test_a_fold_of_rows_in_buckets_needs_no_shuffle(spark):
    rows = in_buckets(spark.range(1000).select((F.col("id") % 7).alias("key"), "id", F.col("id").cast("string").alias("t")), "rows", "key", 4)
    assert "Exchange" not in folds.folded_texts(rows, ["key"], ["id"], ["t"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shapes", [0, 1 << 17])
def test_shared_profiles_merge_like_own_ones(spark, monkeypatch, shapes):
    rng = random.Random(shapes)
    say = lambda: " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randrange(1, 5)))
    some = lambda: [say() for _ in range(rng.randrange(3))]

    def answer():
        out = {s: {f: rng.choice([None, say(), some()]) for f in fields} for s, fields in normal.PROFILE.items()}
        for field, name, lists, texts in (("product_categories", "category_name", "items", ()), ("service_details", "name", "deliverables", ("description", "methodology"))):
            out["offerings"][field] = [{name: rng.choice("ABC"), lists: some()} | {t: say() for t in texts} for _ in range(rng.randrange(4))]
        out["reputation"]["case_studies"] = [{"title": rng.choice("ABC"), "outcome": rng.choice([None, say()])} for _ in range(rng.randrange(4))]
        return json.dumps(out | {"sources": some()})

    rows = [(n, n * 31 % 100, sorted({rng.randrange(9) for _ in range(rng.randrange(7))}), answer()) for n in range(40)] + [(99, 99, [77], "[]")]
    shared = normal.normal_profiles(spark.createDataFrame(rows, "id long, chunk long, companies array<long>, body string"), "body").cache()
    own = shared.select(F.explode("companies").alias("company"), *[c for c in shared.columns if c not in ("companies", "id")])
    want = {r.company: r.profile_json for r in bundle.merged_json(own).collect()}
    monkeypatch.setattr(bundle, "SHAPES", shapes)
    assert {r.company: r.profile_json for r in bundle.merged_json(shared).collect()} == want and len(want) == 10
