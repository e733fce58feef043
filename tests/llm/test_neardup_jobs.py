"""What near-dedup asks of the driver."""

from __future__ import annotations

from test_neardup import near_copies

from wareflow.llm import neardup, shared

NAMES = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"]


def test_steps_are_few_jobs_and_leave_the_session_as_it_was(spark):
    texts = near_copies(60, 80, 9, 1) + near_copies(20, 60, 6, 2)
    before = [spark.conf.get(name) for name in NAMES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("near-dedup", "")
    try:
        neardup.groups(docs, 3, 85)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-dedup"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 80, jobs
    assert [spark.conf.get(name) for name in NAMES] == before


def test_free_memory_of_the_c_library_goes_back(spark):
    assert shared.trimmed(spark)
