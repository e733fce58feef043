"""What the steps of connected components ask of the driver."""

from __future__ import annotations

from wareflow.llm import components

EDGES = [(k, k + 1) for k in range(60) if k % 7] + [(100, k) for k in range(101, 160)]


def test_steps_are_few_jobs_and_leave_the_session_as_it_was(spark):
    names = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(name) for name in names]
    edges = spark.createDataFrame(EDGES, "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        found = components.connected(edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.id: r.component for r in found.collect()}
    assert got == {k: max(k - (k - 1) % 7, 0) if k < 61 else 100 for k in got} and len(got) == len({x for e in EDGES for x in e})
    # The edges and a job a step, in which rows are counted as they are written.
    assert jobs <= 8, jobs
    assert [spark.conf.get(name) for name in names] == before
