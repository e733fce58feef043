"""Sinks that commit, and stages that go on where they were cut off."""

from __future__ import annotations

import base64
import decimal
import glob
import gzip
import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from wareflow.operators.skills import Pause
from wareflow.plans.runner import Run
from wareflow.sources import parts
from wareflow.streaming.control import finish

ROW = "id long, tags array<string>, price decimal(9,2), raw binary"


def rows(spark, n, parts_=4):
    df = spark.range(0, n, 1, parts_)
    return df.select("id", F.array(F.lit("ä"), F.col("id").cast("string")).alias("tags"), (F.col("id") / 2).cast("decimal(9,2)").alias("price"), F.encode(F.col("id").cast("string"), "utf-8").alias("raw"))


@F.pandas_udf(LongType())
def broken_at_7(ids: pd.Series) -> pd.Series:
    if (ids == 7).any():
        raise RuntimeError("stop")
    return ids


def files(path, kind):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/{kind}/*"))


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_rows_come_back_with_their_types(spark, tmp_path, form):
    path = str(tmp_path)
    assert parts.committed(spark, path, ROW, form).count() == 0
    parts.append(rows(spark, 20), path, form=form)
    parts.append(rows(spark, 5).where("id = 3"), path, form=form)
    got = sorted(parts.committed(spark, path, ROW, form).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == sorted([*range(20), 3]) and got[1].tags == ["ä", "1"] and got[1].price == decimal.Decimal("0.50")
    if form == "parquet":
        assert bytes(got[19].raw) == b"18"
    # Tasks without rows leave no part.
    assert len(files(path, "parts")) == 5 and not files(path, "staged")


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path)
    parts.append(rows(spark, 3), path)
    before = files(path, "parts")
    bad = rows(spark, 12, 4).withColumn("id", broken_at_7("id"))
    with pytest.raises(Exception, match="stop"):
        parts.append(bad, path)
    assert files(path, "staged") == [] and len(files(path, "commits")) == 1
    assert sorted(r.id for r in parts.committed(spark, path, ROW).collect()) == [0, 1, 2]
    assert set(before) <= set(files(path, "parts"))


def test_messages_hold_so_many_lines(spark, tmp_path):
    parts.append(rows(spark, 10, 1), str(tmp_path), form="messages", permessage="4")
    bodies = [r.body for r in parts.committed(spark, str(tmp_path), "", "messages").collect()]
    lines = [[json.loads(x)["id"] for x in gzip.decompress(base64.b64decode(b)).decode().split("\n")] for b in bodies]
    assert lines == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_a_batch_that_is_given_again_counts_once(spark, tmp_path):
    spark.dataSource.register(parts.PartsSink)
    rows(spark, 30, 3).write.parquet(f"{tmp_path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return stream.writeStream.format("parts").option("path", f"{tmp_path}/out").option("form", "json").option("checkpointLocation", f"{tmp_path}/{checkpoint}").start()

    finish(run("a"))
    assert parts.committed(spark, f"{tmp_path}/out", ROW, "json").count() == 30
    kept = files(f"{tmp_path}/out", "parts")
    # With a new checkpoint the stream begins anew and gives the same batches again.
    finish(run("b"))
    assert parts.committed(spark, f"{tmp_path}/out", ROW, "json").count() == 30 and files(f"{tmp_path}/out", "parts") == kept


def test_what_the_sink_refuses(spark, tmp_path):
    with pytest.raises(Exception, match="no form"):
        parts.append(rows(spark, 1), str(tmp_path), form="xml")
    spark.dataSource.register(parts.PartsSink)
    with pytest.raises(Exception, match="only ever added"):
        rows(spark, 1).write.format("parts").mode("overwrite").option("path", str(tmp_path)).save()


def counting(log, fail, error=RuntimeError):
    """A stage that writes down which items it worked on, and may fail on one before it has worked on that batch."""

    @F.pandas_udf("long")
    def work(ids: pd.Series) -> pd.Series:
        if fail is not None and (ids == fail).any():
            time.sleep(4)
            raise error("stop")
        with open(log, "a") as f:
            f.writelines(f"{i}\n" for i in ids)
        return ids * 10

    return lambda df: df.repartition(8).withColumn("v", work("id")).withColumn("error", F.when(F.col("id") == 2, "bad item"))


@pytest.mark.parametrize("error", [RuntimeError, Pause])
def test_a_stage_that_is_cut_off_goes_on(spark, tmp_path, error):
    items, log = spark.range(0, 40, 1, 8), f"{tmp_path}/log"
    first = ("double", lambda df: df.withColumn("w", F.col("id") * 2))
    with pytest.raises(Exception, match="stop"):
        Run(spark, f"{tmp_path}/run", [first, ("work", counting(log, 33, error))], {"work": "id"}).go(items)
    seen = [int(x) for x in open(log)]
    assert 0 < len(seen) < 40 and len(set(seen)) == len(seen)
    run = Run(spark, f"{tmp_path}/run", [first, ("work", counting(log, None))], {"work": "id"})
    assert run.next_stage() == 1
    got = run.go(items)
    assert sorted((r.id, r.v, r.w) for r in got.collect()) == [(i, i * 10, i * 2) for i in range(40) if i != 2]
    assert [r.id for r in run.quarantine(1).collect()] == [2]
    seen = [int(x) for x in open(log)]
    assert sorted(seen) == list(range(40))
    assert [tuple(r) for r in run.errors().collect()] == [("work", "stopped", "bad item", 1)]


def test_a_stage_by_parts_without_items(spark, tmp_path):
    run = Run(spark, str(tmp_path), [("work", counting(f"{tmp_path}/log", None))], {"work": "id"})
    assert run.go(spark.range(0)).count() == 0 and run.next_stage() == 1
