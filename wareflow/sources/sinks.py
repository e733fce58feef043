"""Writers: listings, rejected items, feedback events and detail logs."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_listing(items: DataFrame, path: str, kind: str = "parquet") -> None:
    """Listing-ready items; nested columns become JSON where the format is flat."""
    if kind == "csv":
        items = items.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in items.dtypes])
        # Quotes are doubled, so backslashes in JSON are only themselves; read with the same escape.
        items.write.option("header", "true").option("escape", '"').csv(path)
    else:
        items.write.format(kind).save(path)


def quarantine(rows: DataFrame, reason: str, path: str) -> None:
    """Appends the rows that have a reason for rejection; a reason is free text, so it makes no folders."""
    rows.where(F.col(reason).isNotNull()).write.mode("append").parquet(path)


def emit(events: DataFrame, path: str) -> None:
    """Appends feedback events as JSON lines."""
    events.write.mode("append").json(path)


def push_log(rows: DataFrame, path: str) -> None:
    """The complete detail log of a batch, gzipped JSON lines."""
    rows.write.option("compression", "gzip").json(path)


def log_messages(rows: DataFrame, order: str, per_message: int = 10_000) -> DataFrame:
    """(part, body): the detail log as base64 of gzip, in parts of about so many rows."""

    @F.pandas_udf("string")
    def packed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: base64.b64encode(gzip.compress("\n".join(x).encode(), mtime=0)).decode())

    line = F.to_json(F.struct(*rows.columns))
    part = F.floor(F.col(order) / per_message).cast("long")
    parts = rows.select(part.alias("part"), F.struct(F.col(order), line.alias("line")).alias("x")).groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select("part", packed(F.col("xs.line")).alias("body"))
