"""Steps that widen rows run in tasks of a bounded number of lines, whatever their shuffled bytes."""

from quarrymill.plans import facts
from quarrymill.session import table
from quarrymill.staging import tasks_for


def test_supplied_parts_are_not_coalesced(spark, small_dir):
    assert tasks_for(spark.range(1001), 10) == 101
    assert facts.supplied_parts(spark, small_dir).rdd.getNumPartitions() == tasks_for(table(spark, small_dir, "lineitem"))


def test_profiles_are_not_coalesced(spark, small_dir):
    assert facts._profiles(spark, small_dir).rdd.getNumPartitions() == tasks_for(table(spark, small_dir, "lineitem"))
