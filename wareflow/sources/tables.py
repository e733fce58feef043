"""Readers of item files and collectors' databases."""

from __future__ import annotations

import contextlib
import glob
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wareflow.sources.workbooks import XlsxSource

ITEM = "item_id long, title string, desc string, price decimal(18,4), category string, images array<struct<idx: int, path: string, sha256: string>>"


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = ITEM, **options: str) -> DataFrame:
    """Step 0: item files with a stated schema; None leaves it to the files."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


def _databases(path: str) -> list[str]:
    """The files that a path or pattern names, in order; a path that names none is left as it is, for its error."""
    return sorted(glob.glob(path)) or [path]


def _connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.table = options["path"], options["table"]
        self.rows = int(options.get("rowsPerTask", "100000"))

    def partitions(self) -> list[InputPartition]:
        """Ranges of about as many rows each, however the row ids are spread."""
        found: list[InputPartition] = []
        numbered = f'SELECT rowid AS at, row_number() OVER (ORDER BY rowid) AS n FROM "{self.table}"'
        for path in _databases(self.path):
            with contextlib.closing(_connected(path)) as c:
                starts = [r[0] for r in c.execute(f"SELECT at FROM ({numbered}) WHERE (n - 1) % ? = 0 ORDER BY at", (self.rows,))]
                last = c.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0]
            if starts:
                found += [_Range(path, low, high) for low, high in zip(starts, [*starts[1:], last + 1], strict=True)]
        return found or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        columns = ", ".join(f'"{n}"' for n in self.names)
        with contextlib.closing(_connected(partition.path)) as c:
            yield from c.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``: a table of one or several files (a pattern), in ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with contextlib.closing(_connected(_databases(self.options["path"])[0])) as c:
            columns = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for _, name, kind, *_ in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(XlsxSource)
