"""Zip archives: by central directory, safe members only, digests in the same pass, and updates that are whole or refused."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from wareflow.plans import updates
from wareflow.sources import archives

NAMES = {"a/run.py": None, "a..b/c": None, "../x": "unsafe path", "/abs": "unsafe path", "C:\\x": "unsafe path", "a/../b": "unsafe path", "a\\..\\b": "unsafe path", "secret": "not on the whitelist"}


def made(folder, app, files, name="one.zip"):
    os.makedirs(f"{folder}/{app}", exist_ok=True)
    with zipfile.ZipFile(f"{folder}/{app}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in files.items():
            info = zipfile.ZipInfo("x")
            info.filename, info.compress_type = path, zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return f"{folder}/{app}/{name}"


def white(spark, rows):
    return spark.createDataFrame(rows, "app string, path string")


def test_only_safe_and_listed_members_are_unpacked(spark, tmp_path):
    made(tmp_path, "hub", {n: n.encode() * 9 for n in NAMES} | {"dir/": b""})
    made(tmp_path, "seo", {"a/run.py": b"other"})
    listed = white(spark, [("hub", n) for n, why in NAMES.items() if why != "not on the whitelist"] + [("seo", "b")])
    got = {(r.app, r.path): r for r in archives.members(spark, str(tmp_path), listed).collect()}
    assert {k[1]: r.reason for k, r in got.items() if k[0] == "hub"} == NAMES
    assert got["seo", "a/run.py"].reason == "not on the whitelist"
    for (_, path), r in got.items():
        if r.reason is None:
            assert bytes(r.content) == path.encode() * 9 and r.sha256 == hashlib.sha256(bytes(r.content)).hexdigest() and r.size == len(r.content)
        else:
            assert r.content is None and r.sha256 is None


def test_large_damaged_and_no_archives(spark, tmp_path):
    path = made(tmp_path, "hub", {"big": b"\0" * 100_000, "good": b"x", "bad": bytes(range(256)) * 40})
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("bad").header_offset + 60
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\xff\xff\xff\xff")
    found = {r.path: r.reason for r in archives.members(spark, str(tmp_path), mostBytes="50000").collect()}
    assert found == {"big": "too large", "good": None, "bad": "damaged"}
    assert archives.members(spark, f"{tmp_path}/none").count() == 0


def test_members_are_dealt_out_by_their_bytes(spark, tmp_path):
    made(tmp_path, "hub", {f"f{k}": os.urandom(5000) for k in range(20)})
    found = archives.members(spark, str(tmp_path), bytesPerTask="20000")
    assert found.rdd.getNumPartitions() == 5 and found.count() == 20


def test_archives_are_there_once_the_job_is_done(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("app"), F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), F.encode(F.repeat(F.lit("ä"), F.col("id").cast("int")), "utf-8").alias("content")).repartition(4)
    archives.pack(rows, str(tmp_path))
    got = {r.path: bytes(r.content) for r in archives.members(spark, str(tmp_path)).collect()}
    assert got == {f"p/{i}": ("ä" * i).encode() for i in range(40)}
    assert all(f.endswith(".zip") for d in ("0", "1") for f in os.listdir(f"{tmp_path}/{d}"))
    bad = rows.withColumn("path", F.when(F.col("path") != "p/7", F.col("path")))
    with pytest.raises(Exception, match="NoneType|None"):
        archives.pack(bad, f"{tmp_path}/bad")
    assert not [f for _, _, names in os.walk(f"{tmp_path}/bad") for f in names if f.endswith(".zip")]


def manifest(spark, rows):
    return spark.createDataFrame([(a, p, hashlib.sha256(d).hexdigest()) for a, p, d in rows], "app string, path string, sha256 string")


def test_an_update_is_published_whole_or_not_at_all(spark, tmp_path):
    root, listed = f"{tmp_path}/root", white(spark, [("hub", "run.py"), ("hub", "lib.py")])
    files = {"run.py": b"1", "lib.py": b"2", "../evil": b"3", "other": b"4"}
    made(f"{tmp_path}/v1", "hub", files)
    whole = manifest(spark, [("hub", p, d) for p, d in files.items()])
    first = updates.update(spark, f"{tmp_path}/v1", whole, listed, root)
    assert updates.current(spark, root) == first
    assert {r.path: bytes(r.content) for r in spark.read.parquet(first).collect()} == {"run.py": b"1", "lib.py": b"2"}
    made(f"{tmp_path}/changed", "hub", {"run.py": b"1", "lib.py": b"not 2"})
    made(f"{tmp_path}/short", "hub", {"run.py": b"1"})
    made(f"{tmp_path}/twice", "hub", files)
    made(f"{tmp_path}/twice", "hub", {"run.py": b"1"}, "two.zip")
    for folder in ("changed", "short", "twice", "none"):
        with pytest.raises(updates.Refused, match="not what the manifest says"):
            updates.update(spark, f"{tmp_path}/{folder}", whole, listed, root)
    with pytest.raises(updates.Refused, match="1 files"):
        updates.update(spark, f"{tmp_path}/v1", manifest(spark, [("hub", "run.py", b"1")]), listed, root)
    assert updates.current(spark, root) == first
    made(f"{tmp_path}/v2", "hub", {"run.py": b"5", "lib.py": b"6"})
    second = updates.update(spark, f"{tmp_path}/v2", manifest(spark, [("hub", "run.py", b"5"), ("hub", "lib.py", b"6")]), listed, root)
    assert updates.current(spark, root) == second != first
