from __future__ import annotations

from pyspark.sql import functions as F
from wareflow.llm import fitting, quality

COLUMNS = ["doc_id", "text", "lang"]


def drawn(docs, each):
    sample, share = fitting.sampled(docs, "lang", COLUMNS, each)
    rows = [tuple(r) for r in sample.collect()]
    return rows, share


def test_null_and_repeated_keys_do_not_exceed_the_bound(spark):
    ids = spark.range(600)
    null = ids.select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("a").alias("lang"))
    same = ids.select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("b").alias("lang"))
    copies = ids.select(F.lit(8).cast("long").alias("doc_id"), F.lit("one").alias("text"), F.lit("c").alias("lang"))
    rows, share = drawn(null.union(same).union(copies).union(null.select("doc_id", "text", F.lit(None).cast("string"))), 50)
    count = {k: sum(r[2] == k for r in rows) for k in "abc"}
    assert count == {"a": 50, "b": 50, "c": 1} and len(rows) == len(set(rows)) == 101
    assert share == {"a": 50 / 600, "b": 50 / 600, "c": 1.0}


def test_the_sample_is_that_of_the_least_hashes(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("a").alias("lang"))
    rows, _ = drawn(docs.repartition(7), 40)
    least = docs.orderBy(F.xxhash64(*COLUMNS)).limit(40).collect()
    assert sorted(rows) == sorted(map(tuple, least)) and sorted(drawn(docs.repartition(3), 40)[0]) == sorted(rows)


def test_labels_that_repeat_an_id_teach_once(spark, monkeypatch):
    docs = spark.range(40).select((F.col("id") % 20).alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "good words ").otherwise("%% !! "), "id").alias("text"))
    docs = docs.union(spark.range(500).select(F.lit(3).cast("long"), F.concat(F.lit("%% !! x"), "id")))
    labels = spark.range(400).select((F.col("id") % 20).alias("doc_id"), ((F.col("id") + 1) % 2).cast("int").alias("quality"))
    seen, fit = [], fitting.fit
    monkeypatch.setattr(fitting, "fit", lambda sample, *a: (seen.append(sample.groupBy("quality").count().collect()), fit(sample, *a))[1])
    model = quality.fit(docs, labels, each=15)
    assert {r.quality: r["count"] for r in seen[0]} == {0: 15, 1: 15} and model.classes == [0, 1]


def test_limits_go_ahead_of_the_shuffle(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("lang"))
    sample, _ = fitting.sampled(docs, "lang", COLUMNS, 1200)
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
