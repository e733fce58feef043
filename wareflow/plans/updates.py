"""Checks of an application update: manifest, hashes, whitelist and paths; publication by pointer."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.sources import archives
from wareflow.sources.archives import UNSAFE


def safe_path(path: Column) -> Column:
    """Whether a path stays below the folder that it is unpacked in: relative, no drive letter, no ``..`` part."""
    return F.coalesce(~path.rlike(UNSAFE) & (path != ""), F.lit(False))


def manifest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(app, path, change): what an update adds, changes, removes or leaves."""
    here, there = local.select("app", "path", F.col("sha256").alias("here")), remote.select("app", "path", F.col("sha256").alias("there"))
    change = F.when(F.col("here").isNull(), "add").when(F.col("there").isNull(), "remove").when(F.col("here") == F.col("there"), "same").otherwise("change")
    return here.join(there, ["app", "path"], "full").select("app", "path", change.alias("change"))


def allowed(files: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The files that their app's whitelist has and whose path is safe."""
    return files.where(safe_path(F.col("path"))).join(whitelist.select("app", "path").distinct(), ["app", "path"], "left_semi")


def refused(files: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The other files, with the reason."""
    known = whitelist.select("app", "path").distinct().withColumn("_known", F.lit(True))
    rows = files.join(known, ["app", "path"], "left")
    reason = F.when(~safe_path(F.col("path")), "unsafe path").when(F.col("_known").isNull(), "not on the whitelist")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_known")


def mismatches(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows (app, path, sha256) whose file is missing or has another digest in ``found`` (app, path, sha256)."""
    there = found.select(F.col("app").alias("_app"), F.col("path").alias("_path"), F.col("sha256").alias("_found"))
    rows = manifest.join(there, (manifest["app"] == there["_app"]) & (manifest["path"] == there["_path"]), "left")
    return rows.where(F.col("_found").isNull() | (F.col("_found") != F.col("sha256"))).drop("_app", "_path", "_found")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(app, path, sha256) of the files in ``folder``, which has a folder for each app."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/") + "/"
    below = F.substring(F.col("path"), F.locate(root, F.col("path")) + len(root), F.length("path"))
    return files.select(F.substring_index(below, "/", 1).alias("app"), F.substring(below, F.locate("/", below) + 1, F.length(below)).alias("path"), F.sha2("content", 256).alias("sha256"))


def hash_mismatches(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (app, path, sha256) whose file <folder>/<app>/<path> is missing or has another SHA-256."""
    return mismatches(manifest, digests(spark, folder))


POINTER = "version long, folder string"


class Refused(ValueError):
    """An update that is not what its manifest says."""


def update(spark: SparkSession, folder: str, manifest: DataFrame, whitelist: DataFrame, root: str) -> str:
    """Publishes the files of the archives <folder>/<app>/*.zip as the new version under ``root``; its folder.

    Only members that are safe and on the whitelist (app, path) are unpacked, and their digests come from the same pass.
    The unpacked rows are written first.  Where a file of the manifest (app, path, sha256) that the whitelist has is
    missing, damaged, there twice or of another digest, the update is refused and the old version stays.
    """
    named = f"{root}/version-{uuid.uuid4().hex}"
    found = archives.members(spark, folder, whitelist)
    found.where(F.col("reason").isNull()).select("app", "path", "size", "sha256", "content").write.parquet(named)
    written = spark.read.parquet(named)
    wanted = allowed(manifest, whitelist)
    wrong = mismatches(wanted, written.select("app", "path", "sha256")).select("app", "path")
    twice = written.groupBy("app", "path").count().where("count > 1").select("app", "path")
    extra = written.select("app", "path").join(wanted.select("app", "path"), ["app", "path"], "left_anti")
    bad = wrong.unionByName(twice).unionByName(extra).distinct()
    first = bad.orderBy("app", "path").first()
    if first is not None:
        raise Refused(f"{bad.count()} files are not what the manifest says, first {first['app']}/{first['path']}")
    return _point(spark, root, named)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that is published under ``root``; None before the first one."""
    try:
        last = spark.read.schema(POINTER).json(f"{root}/pointer").agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return last and f"{root}/{last.folder}"


def publish(files: DataFrame, root: str) -> str:
    """Writes ``files`` as a new version under ``root``, and only then the row that points to it.

    Readers see the old version until that row is there; a version that was cut off is never seen.
    """
    folder = f"{root}/version-{uuid.uuid4().hex}"
    files.write.parquet(folder)
    return _point(files.sparkSession, root, folder)


def _point(spark: SparkSession, root: str, folder: str) -> str:
    """Lets the pointer of ``root`` point to a written folder below it."""
    number = 0 if current(spark, root) is None else spark.read.schema(POINTER).json(f"{root}/pointer").agg(F.max("version")).first()[0] + 1
    spark.createDataFrame([(number, folder.rsplit("/", 1)[1])], POINTER).coalesce(1).write.mode("append").json(f"{root}/pointer")
    return folder
