import os

from pyspark.sql import functions as F

from cohortkit.session import SHUFFLE_CLEANUP, materialize, release


def test_a_superseded_stage_goes_when_the_next_one_is_written(spark):
    first = materialize(spark.range(100).withColumn("k", F.col("id") % 7), "t")
    path = first._stage_path
    assert os.path.isdir(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    second = materialize(first.groupBy("k").count(), "t", frees=(first,))
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before
    assert not os.path.exists(path)
    assert second.count() == 7 and second.agg(F.sum("count")).first()[0] == 100


def test_release_leaves_other_frames_alone(spark):
    kept = materialize(spark.range(5), "t")
    derived = kept.filter("id > 1")
    release(derived, spark.range(3))
    assert derived.count() == 3
    release(kept)
    release(kept)  # a second time does nothing
