"""Connected components of a graph given by its edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.llm.shared import fixed_plans, let_go, observed, salted_join

#: Edges of a partition in a step, about.
_EDGES = 10_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_join(near.where("v > u"), least, ["u"], ["v"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges come with v < u.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(edges, least, ["u"], ["v"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id with an edge to another.

    Alternates large-star and small-star steps until each id points to the smallest of its component.  Both take a
    minimum by id, which Spark sums up before the shuffle, and hand it to the id's edges by a salted join, so an id
    with a third of all edges is no harder than others.  Each step is written to the shared folder, and its edges are counted
    as they are written.
    """
    marks = {"n": F.count("*"), "s": F.bit_xor(F.xxhash64("u", "v"))}
    now, mark = observed(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), **marks)
    spark, seen = now.sparkSession, None
    while mark["n"] and mark != seen:
        seen = mark
        with fixed_plans(spark, math.ceil(mark["n"] / _EDGES)):
            now, mark = observed(_small_star(_large_star(now)), **marks)
    let_go(spark)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
