"""Bounded, repeatable samples of labelled rows, and scoring of all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareflow.llm.shared import saved, small_batches
from wareflow.llm.subword import Shape, SubwordModel, calibrate, counted, train

#: Rows of all labels together that a sample has at most, about: with more labels each has fewer rows, but one at least.
MAX_ROWS = 6400
#: Parts in which the rows of a label are ranked first.
SALTS = 16
#: Features of all rows together that the driver gets at most, about: 8 bytes each.  A text has at most as many as there
#: are buckets, so only samples of very long texts reach it.
MAX_FEATURES = 24_000_000


def bounded(each: int, labels: int) -> int:
    """Rows of a label when there are so many labels."""
    return min(each, max(1, MAX_ROWS // max(1, labels)))


def sampled(labelled: DataFrame, label: str, columns: list[str], each: int) -> tuple[DataFrame, dict]:
    """At most ``each`` rows of a label, told apart by ``columns``, and by label the share of its distinct rows they are.

    The rows are those with the least hashes of ``columns``, label included: the same ones each time.  Repeated rows
    count once and come once.  Rows without a label are left out; with many labels each has fewer rows.
    """
    known = labelled.where(F.col(label).isNotNull()).select(*columns, F.xxhash64(*columns).alias("_hash"))
    hashes = saved(known.select(F.col(label).alias("_label"), "_hash").distinct())
    counts = {r["_label"]: r["count"] for r in hashes.groupBy("_label").count().collect()}
    each = bounded(each, len(counts))
    # Spark applies larger limits after the shuffle only.
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    labelled.sparkSession.conf.set(name, str(max(each, int(labelled.sparkSession.conf.get(name)))))
    # A task sees at most ``each`` rows of a label from every task before it: the limit is applied ahead of the shuffle too.
    for by in (["_label", F.pmod("_hash", F.lit(SALTS))], ["_label"]):
        hashes = hashes.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash"))).where(F.col("_rank") <= each).drop("_rank")
    # One number a label.
    last = hashes.groupBy("_label").agg(F.max("_hash").alias("_last"))
    rows = known.join(F.broadcast(last), (F.col(label) == F.col("_label")) & (F.col("_hash") <= F.col("_last")))
    return rows.dropDuplicates([label, "_hash"]).select(*columns), {k: min(1.0, each / n) for k, n in counts.items()}


def fit(sample: DataFrame, text: str, label: str, key: str, classes: list, shape: Shape, held_back: float = 0.2) -> SubwordModel:
    """A model trained on ``sample`` (bounded by its maker) and calibrated on a part of it.

    The features are counted where the rows are; the driver gets those of the sample alone, and of a label whose texts
    have more features than its share of MAX_FEATURES only rows up to that, in the order of their keys' hashes.
    """

    @F.arrow_udf("struct<ids: array<int>, weights: array<float>>")
    def count(texts: pa.Array) -> pa.Array:
        found = [counted(t.as_py(), shape) for t in texts]
        ends = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]).astype(np.int32))
        flat = [np.concatenate(x) if found else np.empty(0, kind) for x, kind in zip(zip(*found, strict=True) if found else ((), ()), (np.int32, np.float32), strict=True)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat], ["ids", "weights"])

    rows = sample.select(F.col(key).alias("k"), F.col(label).alias("y"), count(F.col(text)).alias("f")).select("k", "y", "f.*")
    # A label has at most so many rows as the sample takes of it.
    order = Window.partitionBy("y").orderBy(F.xxhash64("k"), F.size("ids"), F.xxhash64("ids"))
    before = F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    got = rows.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < MAX_FEATURES // max(1, len(classes))).drop("before").toArrow()
    # Keys may be null or repeated, so the features decide ties.
    order = sorted(range(len(got)), key=lambda i: (str(got["k"][i].as_py()), str(got["y"][i].as_py()), got["ids"][i].values.to_numpy().tobytes()))
    rows = [(got["ids"][i].values.to_numpy(), got["weights"][i].values.to_numpy()) for i in order]
    place = {c: k for k, c in enumerate(classes)}
    labels = np.array([place[got["y"][i].as_py()] for i in order], np.int64)
    back = int(len(rows) * held_back)
    picked = np.random.default_rng(11).permutation(len(rows))
    late, early = picked[:back], picked[back:]
    # A label of few rows may be held back altogether; those rows are learned.
    alone = ~np.isin(labels[late], labels[early])
    late, early = late[~alone], np.concatenate([early, late[alone]])
    model = calibrate(train([rows[i] for i in early], labels[early], classes, shape), [rows[i] for i in late], labels[late])
    # The sample is not needed any more, and Arrow would keep its memory.
    del got, rows
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, text: str, model: SubwordModel) -> DataFrame:
    """``row``, each row of ``docs`` as a struct, and ``p``, the class probabilities of its whole text (array of double).

    The model that is broadcast has a fixed size: its shape's buckets and dimensions.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def probabilities(texts: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.probabilities(texts)))

    return docs.select(F.struct("*").alias("row"), probabilities(F.col(text)).alias("p"))


def unpacked(found: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The struct column ``row`` as columns, and ``added``, which replace columns of the same name."""
    names = {name.lower() for name in added}
    kept = [F.col("row")[c].alias(c) for c in columns if c.lower() not in names]
    return found.select(*kept, *[value.alias(name) for name, value in added.items()])


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of
