from __future__ import annotations

import base64
import gzip
import hashlib
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F
from wareflow.plans import updates
from wareflow.plans.runner import Pause, Run, remaining
from wareflow.sources import sinks, tables


def stages(fail_at=None, error=RuntimeError):
    def step(k):
        def run(df):
            if k == fail_at:
                raise error("stop")
            out = df.withColumn("v", F.col("v") * 2 + k)
            return out.withColumn("error", F.when(F.col("id") == k, "bad item"))

        return run

    return [(f"s{k}", step(k)) for k in range(4)]


@pytest.mark.parametrize("fail_at", [0, 1, 2, 3])
@pytest.mark.parametrize("error", [RuntimeError, Pause])
def test_a_resumed_run_equals_a_straight_one(spark, tmp_path, fail_at, error):
    items = spark.range(6).withColumn("v", F.col("id"))
    whole = sorted(map(tuple, Run(spark, f"{tmp_path}/whole", stages()).go(items).collect()))
    with pytest.raises(error):
        Run(spark, f"{tmp_path}/cut", stages(fail_at, error)).go(items)
    again = Run(spark, f"{tmp_path}/cut", stages())
    assert again.next_stage() == fail_at
    assert sorted(map(tuple, again.go(items).collect())) == whole
    assert [r[0] for r in whole] == [4, 5]
    assert again.quarantine(1).first().error == "bad item"


def test_runs_of_other_stages_are_refused(spark, tmp_path):
    items = spark.range(2).withColumn("v", F.col("id"))
    Run(spark, str(tmp_path), stages()[:2]).go(items)
    with pytest.raises(ValueError, match="other stages"):
        Run(spark, str(tmp_path), [("x", lambda d: d)]).next_stage()
    assert remaining(items, items.where("id = 0"), "id").count() == 1


def test_paths_and_manifests(spark):
    paths = {"a/b": True, "a..b/c": True, "../x": False, "/abs": False, "C:\\x": False, "a/../b": False, "a\\..\\b": False, "": False}
    rows = spark.createDataFrame(list(paths.items()), "path string, wanted boolean")
    assert rows.where(updates.safe_path(F.col("path")) != F.col("wanted")).count() == 0
    local = spark.createDataFrame([("h", "a", "1"), ("h", "b", "1"), ("h", "c", "1")], "app string, path string, sha256 string")
    remote = spark.createDataFrame([("h", "a", "1"), ("h", "b", "2"), ("h", "d", "1")], "app string, path string, sha256 string")
    assert {r.path: r.change for r in updates.manifest_diff(local, remote).collect()} == {"a": "same", "b": "change", "c": "remove", "d": "add"}


def test_hashes_of_files(spark, tmp_path):
    for at in ("hub/run.py", "hub/a/run.py", "seo/run.py"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(at.encode())
    right = [("hub", "run.py"), ("hub", "a/run.py"), ("seo", "run.py")]
    rows = [(a, p, hashlib.sha256(f"{a}/{p}".encode()).hexdigest()) for a, p in right] + [("seo", "a/run.py", "x"), ("hub", "gone", "x")]
    manifest = spark.createDataFrame(rows, "app string, path string, sha256 string")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert {(r.app, r.path) for r in updates.hash_mismatches(spark, folder, manifest).collect()} == {("seo", "a/run.py"), ("hub", "gone")}


def test_a_version_is_seen_once_it_is_whole(spark, tmp_path):
    root, files = str(tmp_path), spark.range(3)
    assert updates.current(spark, root) is None
    first = updates.publish(files, root)
    assert updates.current(spark, root) == first

    def cut_off(_):
        raise RuntimeError("stop")

    bad = files.select(F.udf(cut_off, "long")("id").alias("id"))
    with pytest.raises(Exception, match="stop"):
        updates.publish(bad, root)
    assert updates.current(spark, root) == first
    second = updates.publish(files.where("id > 0"), root)
    assert updates.current(spark, root) == second and spark.read.parquet(second).count() == 2


def test_row_ids_far_apart_make_few_tasks(spark, tmp_path):
    tables.register(spark)
    with sqlite3.connect(tmp_path / "y.db") as c:
        c.execute("CREATE TABLE goods (id INTEGER PRIMARY KEY, title TEXT)")
        c.executemany("INSERT INTO goods VALUES (?, ?)", [(1, "a"), (5 * 10**9, "b"), (-7, "c")])
    got = spark.read.format("sqlite").option("path", str(tmp_path / "y.db")).option("table", "goods").option("rowsPerTask", "2").load()
    assert got.rdd.getNumPartitions() == 2 and sorted(r.title for r in got.collect()) == ["a", "b", "c"]


def test_sqlite_and_xlsx(spark, tmp_path):
    tables.register(spark)
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("CREATE TABLE goods (id INTEGER, title TEXT, price REAL)")
        c.executemany("INSERT INTO goods VALUES (?, ?, ?)", [(i, f"t{i}", i / 2) for i in range(25)] + [(99, None, None)])
    got = spark.read.format("sqlite").option("path", str(tmp_path / "x.db")).option("table", "goods").option("rowsPerTask", "10").load()
    assert got.rdd.getNumPartitions() == 3 and got.count() == 26 and got.agg(F.sum("price")).first()[0] == 150.0
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>甲</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>8</v></c></row></sheetData></worksheet>')
    sheet = spark.read.format("xlsx").schema("name string, n string").option("path", str(tmp_path / "x.xlsx")).load()
    assert [tuple(r) for r in sheet.collect()] == [("甲", "7"), (None, "8")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a"], None), (2, [], "logo")], "id int, tags array<string>, reason string")
    sinks.write_listing(rows, f"{tmp_path}/csv", "csv")
    assert tables.load(spark, f"{tmp_path}/csv", "csv", "id int, tags string, reason string", header="true", escape='"').where("id = 1").first().tags == '["a"]'
    sinks.quarantine(rows, "reason", f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 1
    sinks.emit(rows, f"{tmp_path}/events")
    sinks.push_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == spark.read.json(f"{tmp_path}/events").count() == 2
    body = sinks.log_messages(rows, "id", 10).first().body
    assert [json.loads(x)["id"] for x in gzip.decompress(base64.b64decode(body)).decode().split("\n")] == [1, 2]
