from __future__ import annotations

from pyspark.sql import functions as F
from wareflow.plans import control
from wareflow.streaming import control as streaming


def _streamed(spark, rows, path, order):
    """The rows as a stream of three files, in their order."""
    numbered = rows.toPandas().sort_values(order)
    size = -(-len(numbered) // 3)
    for k in range(3):
        spark.createDataFrame(numbered.iloc[k * size : (k + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rates_of_a_stream_equal_those_of_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type != 'view'")
    rows = events.select("event_id", "ts", (F.col("user_id") % 12).alias("stage"), (F.col("event_type") == "error").alias("failed"))
    q = streaming.fail_rates(_streamed(spark, rows, f"{tmp_path}/in", ["ts", "event_id"])).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    streaming.finish(q)
    batch = control.fail_rates(rows, "stage", "ts", "event_id", "failed").select("event_id", "stage", "n", "fail_rate")
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))


def test_ledger_of_a_stream_equals_that_of_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type != 'view' and user_id < 60").withColumn("product", F.col("event_id") % 7)
    ops = control.attributed(events, "user_id", "ts", "event_id", "product", F.col("event_type") == "error")
    stream = _streamed(spark, ops.withColumn("quota_day", F.col("quota_day").cast("string")), f"{tmp_path}/in", ["ts", "key"])
    seen = f"{tmp_path}/out"
    q = streaming.ledger(stream, 2).writeStream.outputMode("update").foreachBatch(lambda df, k: df.withColumn("k", F.lit(k)).write.mode("append").parquet(seen)).option("checkpointLocation", f"{tmp_path}/c").start()
    streaming.finish(q)
    last = spark.read.parquet(seen).groupBy("tenant", "quota_day").agg(F.max_by(F.struct("used", "denied", "refunded"), "k").alias("x")).select("tenant", "quota_day", "x.*")
    batch = control.ledger(ops, 2).withColumn("quota_day", F.col("quota_day").cast("string"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_events_are_all_there_after_the_end(spark, tmp_path):
    rows = spark.range(30).select("id", F.lit("x").alias("kind"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.finish(streaming.emit(stream, f"{tmp_path}/out", f"{tmp_path}/c"))
    assert spark.read.json(f"{tmp_path}/out").count() == 30


def test_caps_of_a_stream_equal_the_batch_path_and_rule_the_work(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type != 'view'")
    middle = events.selectExpr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)").first()[0]
    late = F.expr(f"unix_micros(cast(ts as timestamp)) > {middle}")
    rows = events.select("event_id", "ts", (F.col("user_id") % 5).alias("stage"), F.when(late, F.expr("event_type = 'error'")).otherwise(F.expr("event_type = 'error' and value > 60")).alias("failed"))
    wanted = control.cap_path(control.fail_rates(rows, "stage", "ts", "event_id", "failed"), "stage")
    live, used = control.LiveCaps(spark, f"{tmp_path}/live"), []

    def decided(batch, number):
        batch.write.mode("append").parquet(f"{tmp_path}/path")
        live(batch, number)
        # What is to be done now goes out in as many tasks as the cap allows.
        control.capped(lambda df: used.append((live.cap(3), df.rdd.getNumPartitions())), lambda: live.cap(3))(spark.range(100), number)

    stream = _streamed(spark, rows, f"{tmp_path}/in", ["ts", "event_id"])
    q = streaming.caps(stream).writeStream.foreachBatch(decided).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    streaming.finish(q)
    path = spark.read.parquet(f"{tmp_path}/path")
    assert sorted(map(tuple, path.collect())) == sorted(map(tuple, wanted.collect()))
    last = {r.stage: r.cap for r in control.last_caps(wanted, "stage").collect()}
    assert {s: live.cap(s) for s in last} == last and live.cap("none") == 8
    assert len(used) >= 3 and all(cap == tasks for cap, tasks in used) and len({cap for cap, _ in used}) > 1
    # A new process begins with what was kept; a batch that is given again changes nothing.
    again = control.LiveCaps(spark, f"{tmp_path}/live")
    assert again.caps == last
    again(path.withColumn("cap", F.lit(1).cast("long")), again.last)
    assert again.caps == last
