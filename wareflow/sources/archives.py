"""Zip archives as a data source: read by their central directories, written an archive a task.

The driver reads the directories (names, places and sizes) and deals the members out by their packed bytes; a task opens
its archive, goes to its members, and inflates, hashes and checks each in one pass.  Members whose path is unsafe, that
are not on the whitelist, or that say they are larger than ``mostBytes`` are not unpacked; they come as rows with
the reason.  Archives are <path>/<app>/*.zip, in a folder that driver and executors see under the same name.
"""

from __future__ import annotations

import contextlib
import glob
import hashlib
import json
import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Paths that leave the folder they are unpacked in: absolute ones, drive letters, and any ``..`` part.
UNSAFE = r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"
_UNSAFE = re.compile(UNSAFE)
SCHEMA = "app string, archive string, path string, size bigint, sha256 string, content binary, reason string"
_BLOCK = 1 << 20


class _Members(InputPartition):
    def __init__(self, app: str, archive: str, places: list[int]):
        super().__init__((app, archive, places))
        self.app, self.archive, self.places = app, archive, places


def _files(path: str) -> list[tuple[str, str]]:
    """(app, archive) of every archive, in order."""
    return [(os.path.basename(os.path.dirname(f)), f) for f in sorted(glob.glob(f"{glob.escape(path)}/*/*.zip"))]


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.most, self.per_task = int(options.get("mostbytes", str(1 << 30))), int(options.get("bytespertask", str(64 << 20)))
        known = options.get("whitelist")
        self.known = None if known is None else {app: set(paths) for app, paths in json.loads(known).items()}

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for app, archive in _files(self.path):
            with zipfile.ZipFile(archive) as z:
                places, size = [], 0
                for k, member in enumerate(z.infolist()):
                    if member.is_dir():
                        continue
                    places.append(k)
                    size += member.compress_size if self._refused(app, member) is None else 0
                    if size >= self.per_task:
                        found.append(_Members(app, archive, places))
                        places, size = [], 0
                if places:
                    found.append(_Members(app, archive, places))
        return found or [_Members("", "", [])]

    def _refused(self, app: str, member: zipfile.ZipInfo) -> str | None:
        if _UNSAFE.search(member.orig_filename) or not member.orig_filename or "\0" in member.orig_filename:
            return "unsafe path"
        if self.known is not None and member.orig_filename not in self.known.get(app, ()):
            return "not on the whitelist"
        if member.file_size > self.most:
            return "too large"
        return None

    def read(self, partition: _Members) -> Iterator[tuple]:
        if not partition.places:
            return
        with zipfile.ZipFile(partition.archive) as z:
            members = z.infolist()
            for k in partition.places:
                member = members[k]
                refused = self._refused(partition.app, member)
                size, digest, content = (member.file_size, None, None) if refused else self._unpacked(z, member)
                if refused is None and content is None:
                    refused = "damaged"
                yield partition.app, os.path.basename(partition.archive), member.orig_filename, size, digest, content, refused

    @staticmethod
    def _unpacked(z: zipfile.ZipFile, member: zipfile.ZipInfo) -> tuple[int, str | None, bytes | None]:
        """Size, digest and bytes of a member; it can not give more bytes than it says, and they fit its checksum."""
        digest, blocks, size = hashlib.sha256(), [], 0
        try:
            with z.open(member) as f:
                while block := f.read(_BLOCK):
                    digest.update(block)
                    blocks.append(block)
                    size += len(block)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            return size, None, None
        return (size, digest.hexdigest(), b"".join(blocks)) if size == member.file_size else (size, None, None)


@dataclass
class _Archives(WriterCommitMessage):
    staged: list[tuple[str, str]]


class _ZipWriter(DataSourceArrowWriter):
    """An archive for each app that a task has rows of, named when the whole job is done."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Archives:
        number, open_, staged = TaskContext.get().partitionId(), {}, []
        try:
            for batch in iterator:
                for app, path, content in zip(*(batch.column(c).to_pylist() for c in ("app", "path", "content")), strict=True):
                    if app not in open_:
                        os.makedirs(f"{self.path}/{app}", exist_ok=True)
                        name = f"{self.path}/{app}/{self.job}-{number}.zip"
                        staged.append((f"{name}.{uuid.uuid4().hex}.staged", name))
                        open_[app] = zipfile.ZipFile(staged[-1][0], "w", zipfile.ZIP_DEFLATED)
                    # A fixed time, so that equal rows make equal archives.
                    member = zipfile.ZipInfo(path)
                    member.filename, member.compress_type = path, zipfile.ZIP_DEFLATED
                    open_[app].writestr(member, content or b"")
            for z in open_.values():
                z.close()
        except BaseException:
            for z in open_.values():
                with contextlib.suppress(Exception):
                    z.close()
            self.abort([_Archives(staged)])
            raise
        return _Archives(staged)

    def commit(self, messages: list) -> None:
        for m in messages:
            for staged, name in m.staged if m else ():
                os.replace(staged, name)

    def abort(self, messages: list) -> None:
        for m in messages:
            for staged, _ in m.staged if m else ():
                with contextlib.suppress(FileNotFoundError):
                    os.remove(staged)


class ZipSource(DataSource):
    """``format("zip")``: reads members with ``path``, ``whitelist`` (JSON), ``mostBytes`` and ``bytesPerTask``; writes rows (app, path, content)."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZipReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ZipWriter(self.options["path"])


def members(spark: SparkSession, folder: str, whitelist: DataFrame | None = None, **options: str) -> DataFrame:
    """The members of all archives <folder>/<app>/*.zip: app, archive, path, size, sha256, content, and reason where not unpacked.

    The whitelist (app, path), a list of the files that an app has, goes to the tasks whole; more than a million of them are refused.
    """
    spark.dataSource.register(ZipSource)
    reader = spark.read.format("zip").options(path=folder, **options)
    if whitelist is not None:
        rows = whitelist.select("app", "path").distinct().limit(1_000_001).collect()
        if len(rows) > 1_000_000:
            raise ValueError("the whitelist has more than a million files")
        known: dict[str, list[str]] = {}
        for r in rows:
            known.setdefault(r["app"], []).append(r["path"])
        reader = reader.option("whitelist", json.dumps(known))
    return reader.load()


def pack(files: DataFrame, folder: str) -> None:
    """Writes ``files`` (app, path, content) as archives <folder>/<app>/*.zip; rows of one app may come in several."""
    files.sparkSession.dataSource.register(ZipSource)
    files.select("app", "path", "content").write.format("zip").mode("append").option("path", folder).save()
