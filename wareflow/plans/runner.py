"""Runs stages one after the other, each behind a written table, and resumes where a run stopped.

A stage's rows are written to a folder of their own, and a row in the run's manifest then publishes it; a stage
that was cut off has no such row and is run again.  A stage that works row by row can be run by parts: each task's
rows count as soon as it is done, and when such a stage is run again it gets only the items that have no row yet.  A stage function may set an ``error`` column: those rows go to
the quarantine of the stage, the others on to the next one.  Errors of a stage end the run; ``Pause`` ends it too
and is never taken for an item's error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.operators.skills import Pause
from wareflow.sources import parts

__all__ = ["ORDER", "Pause", "Run", "remaining"]

#: The order of the steps.
ORDER = ("0", "A", "B", "C", "D", "E", "G", "F", "H", "I", "J", "K0", "K")
MANIFEST = "number int, stage string, folder string"


class Run:
    """A run of ``stages`` (name, DataFrame -> DataFrame) kept under ``folder``, which all executors see.

    ``by_parts`` names the stages that are run by parts, with the column that identifies an item.  Such a stage gives
    one row or more for each item, in the task that has the item (no shuffle): an item without a row is done again.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], by_parts: Mapping[str, str] | None = None):
        self.spark, self.folder, self.stages, self.by_parts = spark, folder.rstrip("/"), list(stages), dict(by_parts or {})

    def _manifest(self) -> list:
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest").collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(rows, key=lambda r: r.number)

    def next_stage(self) -> int:
        """The number of the first stage that is not published."""
        done = [r.stage for r in self._manifest()]
        if done != [name for name, _ in self.stages[: len(done)]]:
            raise ValueError(f"the folder holds a run of other stages: {done}")
        return len(done)

    def _rows(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._manifest()[number].folder}")

    def output(self, number: int) -> DataFrame:
        """The rows without an error of a published stage."""
        rows = self._rows(number)
        return rows.where(F.col("error").isNull()).drop("error") if "error" in rows.columns else rows

    def quarantine(self, number: int) -> DataFrame | None:
        rows = self._rows(number)
        return rows.where(F.col("error").isNotNull()) if "error" in rows.columns else None

    def errors(self) -> DataFrame:
        """(stage, fate, kind, rows): how many rows each class of error stopped, or only marked with a warning, in each stage."""
        found = None
        for number, (name, _) in enumerate(self.stages[: self.next_stage()]):
            rows = self._rows(number)
            texts = [F.array(F.struct(F.lit("stopped").alias("fate"), F.col("error").alias("text")))] if "error" in rows.columns else []
            # A warning is carried on; it is counted in the last stage, whose rows have them all.
            if "warnings" in rows.columns and number == self.next_stage() - 1:
                texts.append(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.struct(F.lit("warned").alias("fate"), w.alias("text"))))
            if texts:
                each = rows.select(F.explode(F.concat(*texts)).alias("e")).where("e.text is not null")
                each = each.select(F.lit(name).alias("stage"), "e.fate", F.substring_index("e.text", ":", 2).alias("kind"))
                found = each if found is None else found.unionByName(each)
        empty = self.spark.createDataFrame([], "stage string, fate string, kind string")
        return (empty if found is None else found).groupBy("stage", "fate", "kind").agg(F.count("*").alias("rows"))

    def go(self, items: DataFrame) -> DataFrame:
        """Runs what is left; ``items`` are read only where no stage is published yet."""
        for number in range(self.next_stage(), len(self.stages)):
            name, stage = self.stages[number]
            given = items if number == 0 else self.output(number - 1)
            if name in self.by_parts:
                folder = self._by_parts(number, stage, given, self.by_parts[name])
            else:
                folder = f"stage-{number}-{uuid.uuid4().hex}"
                stage(given).write.parquet(f"{self.folder}/{folder}")
            row = self.spark.createDataFrame([(number, name, folder)], MANIFEST)
            row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return self.output(len(self.stages) - 1)

    def _by_parts(self, number: int, stage: Callable[[DataFrame], DataFrame], items: DataFrame, key: str) -> str:
        """Works on the items that no part has yet; the folder of the parts, relative to the run's."""
        path = f"{self.folder}/stage-{number}-parts"
        made = stage(items)
        done = parts.committed(self.spark, path, made.schema, publish="task").select(F.struct(F.col(key).alias("key")).alias("__done")).distinct()
        left = items.withColumn("__done", F.struct(F.col(key).alias("key"))).join(done, "__done", "left_anti").drop("__done")
        parts.append(stage(left), path, publish="task")
        if not parts.committed(self.spark, path, made.schema, publish="task").inputFiles():
            # Not even an empty part: the stage has no rows.
            made.limit(0).write.mode("append").parquet(f"{path}/parts")
        return f"stage-{number}-parts/parts"


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items whose key is not among those that are done."""
    return items.join(done.select(key).distinct(), key, "left_anti")
