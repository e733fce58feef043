"""Sinks whose parts count once they are committed: for logs, feedback and the stages of a run.

``format("parts")`` writes each task's rows to a part of its own (Parquet, JSON lines, or messages of gzip in base64)
and a commit then names the parts.  Readers see named parts only.

- A batch job's commit names all its parts at once; a job that fails takes its parts away.
- A stream's commit carries the micro-batch's number: a batch that is given again is not taken twice.
- With ``publish`` set to ``task`` a part counts as soon as its task is done, so that a job that is cut off leaves what it
  has finished.  Of several attempts at a task one part counts.

``path`` is a folder that driver and executors see under the same name.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The written forms and the ends of their names.
ENDS = {"parquet": ".parquet", "json": ".json.gz", "messages": ".messages"}


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    rows: int


def _put(path: str, text: str) -> bool:
    """Writes a file under its name at once; False where the name is taken."""
    staged = f"{path}.{uuid.uuid4().hex}"
    with open(staged, "w", encoding="utf-8") as f:
        f.write(text)
    return _taken_over(staged, path)


def _taken_over(staged: str, path: str) -> bool:
    """Gives a written file its name; False, and the file is gone, where another has the name."""
    try:
        os.link(staged, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.remove(staged)


class _Task:
    """Writes the rows of one task; the file exists only if all of them were written."""

    def __init__(self, path: str, form: str, publish: str, per_message: int, job: str):
        self.path, self.form, self.publish, self.per_message, self.job = path, form, publish, per_message, job

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        number = TaskContext.get().partitionId()
        staged = f"{self.path}/staged/{self.job}-{number}-{uuid.uuid4().hex}{ENDS[self.form]}"
        try:
            rows = getattr(self, f"_{self.form}")(staged, batches)
        except BaseException:
            with contextlib.suppress(FileNotFoundError):
                os.remove(staged)
            raise
        if not rows:
            with contextlib.suppress(FileNotFoundError):
                os.remove(staged)
            return _Part(None, 0)
        if self.publish == "task":
            name = f"{self.job}-{number}{ENDS[self.form]}"
            _taken_over(staged, f"{self.path}/parts/{name}")
        else:
            name = os.path.basename(staged)
            os.replace(staged, f"{self.path}/parts/{name}")
        return _Part(name, rows)

    def _parquet(self, staged: str, batches: Iterator[pa.RecordBatch]) -> int:
        rows, out = 0, None
        try:
            for batch in batches:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(staged, batch.schema)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out:
                out.close()
        return rows

    @staticmethod
    def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        for batch in batches:
            for row in batch.to_pylist():
                yield json.dumps(row, ensure_ascii=False, default=lambda v: base64.b64encode(v).decode() if isinstance(v, bytes) else str(v))

    def _json(self, staged: str, batches: Iterator[pa.RecordBatch]) -> int:
        rows = 0
        with gzip.open(staged, "wt", encoding="utf-8") as f:
            for rows, line in enumerate(self._lines(batches), 1):
                f.write(f"{line}\n")
        return rows

    def _messages(self, staged: str, batches: Iterator[pa.RecordBatch]) -> int:
        rows, held = 0, []

        def pushed(f) -> None:
            f.write(base64.b64encode(gzip.compress("\n".join(held).encode(), mtime=0)).decode() + "\n")
            held.clear()

        with open(staged, "w", encoding="ascii") as f:
            for rows, line in enumerate(self._lines(batches), 1):
                held.append(line)
                if len(held) == self.per_message:
                    pushed(f)
            if held:
                pushed(f)
        return rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, task: _Task):
        self.path, self.task = path, task

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        return self.task.write(iterator)

    def commit(self, messages: list) -> None:
        self._commit(f"job-{self.task.job}", messages)

    def abort(self, messages: list) -> None:
        if self.task.publish == "job":
            self._remove(messages)

    def _commit(self, name: str, messages: list) -> None:
        if self.task.publish == "task":
            return
        parts = sorted(m.name for m in messages if m and m.name)
        if not _put(f"{self.path}/commits/{name}", json.dumps(parts)):
            self._remove(messages)

    def _remove(self, messages: list) -> None:
        for m in messages:
            if m and m.name:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{self.path}/parts/{m.name}")


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._commit(f"batch-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._remove(messages)


class PartsSink(DataSource):
    """``df.write.format("parts").option("path", ...)``, with ``form`` (parquet, json or messages), ``publish`` (job or task), ``perMessage`` and ``job``."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        raise ValueError("parts are read by committed()")

    def _task(self) -> _Task:
        path, form, publish = self.options["path"].rstrip("/"), self.options.get("form", "parquet"), self.options.get("publish", "job")
        if form not in ENDS or publish not in ("job", "task"):
            raise ValueError(f"no form {form} published by {publish}")
        for folder in ("parts", "staged", "commits"):
            os.makedirs(f"{path}/{folder}", exist_ok=True)
        return _Task(path, form, publish, int(self.options.get("permessage", "1000")), self.options.get("job", uuid.uuid4().hex))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("parts are only ever added")
        task = self._task()
        return _Writer(task.path, task)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:  # noqa: N802
        task = self._task()
        if task.publish == "task":
            raise ValueError("a stream's parts are published by batch")
        return _StreamWriter(task.path, task)


def _names(spark: SparkSession, path: str, publish: str) -> list[str]:
    """The parts that count, as Spark sees the folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{'parts' if publish == 'task' else 'commits'}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    if publish == "task":
        return sorted(f"{path}/parts/{f.getPath().getName()}" for f in fs.listStatus(at))
    try:
        rows = spark.read.text(f"{path}/commits", wholetext=True).toLocalIterator()
    except AnalysisException:
        return []
    return sorted(f"{path}/parts/{name}" for r in rows for name in json.loads(r[0]))


def committed(spark: SparkSession, path: str, schema: str, form: str = "parquet", publish: str = "job") -> DataFrame:
    """The rows of the parts under ``path`` that count, an empty table where there is none; messages as ``body`` strings."""
    path = path.rstrip("/")
    names = _names(spark, path, publish)
    if form == "messages":
        return spark.read.text(names).toDF("body") if names else spark.createDataFrame([], "body string")
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format("parquet" if form == "parquet" else "json").load(names)


def append(rows: DataFrame, path: str, **options: str) -> None:
    """Adds ``rows`` to the parts under ``path``."""
    # Within foreachBatch the rows' session is a copy, and the active one is where names are looked up.
    for session in {rows.sparkSession, SparkSession.getActiveSession() or rows.sparkSession}:
        session.dataSource.register(PartsSink)
    rows.write.format("parts").mode("append").options(path=path, **options).save()
