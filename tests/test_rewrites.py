"""Rewriting answers is dealt out to many tasks and done once for each answer."""

from quarrymill.plans import bundles, chunks


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_answers_of_one_file_are_many_tasks(spark, small_dir):
    assert bundles.answers(spark, small_dir).rdd.getNumPartitions() >= 64


def test_stored_answers_are_rewritten_once(spark, small_dir):
    assert "parse_json(" in plan(bundles.normal_profiles(spark, small_dir))
    assert "parse_json(" not in plan(bundles.upserted_profile_json(spark, small_dir))


def test_answers_are_rewritten_for_each_part_and_not_for_each_supplier(spark, small_dir, monkeypatch):
    given, merge = [], bundles.bd.merged_profiles
    monkeypatch.setattr(bundles.bd, "merged_profiles", lambda partial: given.append(partial) or merge(partial))
    bundles.merged_bundles(spark, small_dir)
    assert "parse_json(" not in plan(given[0])


def test_content_is_prepared_and_cut_once(spark, small_dir):
    assert plan(chunks.processed_content(spark, small_dir)).count("MapInArrow") == 1
