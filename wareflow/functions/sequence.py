"""Numbering and rolling windows over long ordered histories, without one task a key.

A plain ``row_number().over(partitionBy(key))`` puts all rows of a key into one task.  Here rows are numbered
within small buckets of the order column, and bucket counts, summed up over the few rows that they are, say where
each bucket starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with ``name``: the row's number from 1 within its keys, in ``order``; ``bucket`` must not fall along it.

    No row is lost: null keys are a key of their own, and null buckets come first, as nulls do in ``order``.  Structs
    hold them, since structs with equal fields are equal, nulls among them.
    """
    rows = df.withColumn("__key", F.struct(*keys)).withColumn("__bucket", F.struct(bucket))
    counts = rows.groupBy("__key", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__key", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy(*order))
    found = rows.withColumn("__inside", inside).join(starts, ["__key", "__bucket"])
    return found.withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).drop("__key", "__bucket", "__start", "__inside")


def rolling(df: DataFrame, keys: list[str], seq: str, width: int, columns: dict[str, Callable[[Window], Column]], block: int = 50_000) -> DataFrame:
    """``df`` with aggregates over the last ``width`` rows of a key, rows being numbered from 1 by ``seq``.

    A key is dealt out in blocks; the last ``width - 1`` rows of a block are also sent to the next one.
    """
    own = F.floor((F.col(seq) - 1) / block).cast("long")
    spills = F.floor((F.col(seq) - 1 + width - 1) / block).cast("long")
    dealt = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, spills)))
    window = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(-(width - 1), 0)
    found = dealt.withColumns({name: make(window) for name, make in columns.items()})
    return found.where("_block = _own").drop("_own", "_block")
