"""Intermediate tables in the folder that driver and executors share, and joins that split hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Paths of the tables written since the outermost ``tidy`` function began.
_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on a local master, as in tests, a temporary folder."""
    set_up = spark.conf.get("spark.checkpoint.dir", None)
    if set_up:
        return set_up.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault("", tempfile.mkdtemp(prefix="wareflow-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
    """``saved``, and aggregates of its rows that are taken while it is written, without a job of their own."""
    seen = Observation()
    table = saved(df.observe(seen, *[value.alias(name) for name, value in values.items()]))
    return table, seen.get


@contextmanager
def fixed_plans(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Plans made within are carried out as they stand, with at most ``partitions`` of a shuffle.

    For steps that are repeated on small rows: Spark would plan such a step anew after each of its shuffles, and the
    driver would hold the plans, the threads that wait for each part, and what it broadcasts instead of a shuffle.
    """
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    name = "spark.sql.shuffle.partitions"
    wanted[name] = str(max(1, min(partitions, int(spark.conf.get(name)))))
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``saved``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Lets the driver's JVM free what the plans of a long piece of work left: their classes, states and broadcasts.

    What compiling their code took from the C library stays with it after that, so it is asked to return it.
    """
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Whether the driver's JVM had the C library return free memory, by the diagnostic command System.trim_native_heap.

    JVMs of other systems, and older ones, do not have the command; then nothing happens.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, values = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # The server's own class is not public, so its method is called by the public interface.
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return False
    return True


@contextmanager
def spent(spark: SparkSession) -> Iterator[None]:
    """The tables that ``saved`` writes within go at its end; for work whose result does not read them."""
    let_go(spark)
    _open.append([])
    try:
        yield
    finally:
        removed(spark, _open.pop())
        let_go(spark)


def within_spent(work: Callable) -> Callable:
    """For functions of a DataFrame that return no DataFrame: the tables that they write go."""

    @wraps(work)
    def run(first: DataFrame, *args, **kwargs):
        with spent(first.sparkSession):
            return work(first, *args, **kwargs)

    return run


def tidy(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return a DataFrame: it is written, and the tables that ``work`` wrote before go."""

    @wraps(work)
    def run(*args, **kwargs) -> DataFrame:
        _open.append([])
        try:
            found = work(*args, **kwargs)
            result = saved(found)
            *spent, last = _open[-1]
        except BaseException:
            _open.pop()
            raise
        _open.pop()
        removed(result.sparkSession, spent)
        let_go(result.sparkSession)
        if _open:
            _open[-1].append(last)
        return result

    return run


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key.

    However many rows a key has, they are dealt over the tasks by a hash of ``by``: the keys first get their
    row of the table once for each salt that occurs, and the rows then join on key and salt.
    """
    salts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    here = salted.select(*on, "_salt").distinct().join(table, on)
    return salted.join(here, [*on, "_salt"], how).drop("_salt")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], by: list[str], most: int = 100_000) -> DataFrame:
    """``rows`` joined with ``table``, one row a key: broadcast where it has at most ``most`` rows, dealt by ``salted_join`` where it has more."""
    table = saved(table)
    if table.count() <= most:
        return rows.join(F.broadcast(table), on)
    return salted_join(rows, table, on, by)


def shuffled_join(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with a table that grows with them: by shuffles at every size, so that plans do not change with it."""
    return rows.join(table.hint("merge"), on, how)


#: Keys that are dealt out at most.
HOT = 2000
#: Rows that a key may have before it is dealt out, whatever the share.
_FEW = 1000


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``shuffled_join`` with a table of one row a key, in which hot keys do not meet in one task.

    The table's column ``rows`` says how many of the ``total`` rows may have the key, and is left out.  Keys with more than
    1/HOT of all rows, fewer than HOT keys then, are broadcast with their number of parts; their rows are dealt over the
    parts as they come, whatever they hold, and the table has a row for each part.
    """
    part = max(_FEW, total // HOT)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / part)).cast("int")
    hot = table.where(F.col("rows") > part).select(*on, parts.alias("_parts"))
    known = rows.join(F.broadcast(hot), on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = known.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).drop("_parts")
    each = table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("rows")
    return shuffled_join(dealt, each, [*on, "_part"], how).drop("_part")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows an Arrow batch to ``rows``: whole texts are long, and a worker holds a batch and its results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
