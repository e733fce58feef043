"""Quality classifier: supervised subword embeddings, averaged, with a softmax output.

Scores are probabilities of label 1.  Null texts count as empty.  Rows without a label, and labels of rows that
are not there, teach nothing; with no labelled rows at all every score is 1 (nothing is known to be bad).
Repeated rows get the same score.  Columns of the input are kept; those added replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm import fitting
from wareflow.llm.shared import saved, within_spent
from wareflow.llm.subword import Shape, SubwordModel

#: Case tells shouting from prose, so it stays.
SHAPE = Shape(lower=False)
#: Labelled rows of each label that training reads at most.
SAMPLE_EACH = 1200
THRESHOLD = 0.3
FOLDS = 5


@within_spent
def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, key: str = "doc_id", text: str = "text", label: str = "quality") -> SubwordModel | None:
    """A model of ``label`` (0 or 1) from ``each`` rows of either label at most; None without labelled rows."""
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label))
    ids, share = fitting.sampled(known, label, [key, label], each)
    if not share:
        return None
    # At most 2 * each ids, so the texts stay where they are; an id may have many rows, which are sampled again.
    rows = saved(docs.select(key, text).join(F.broadcast(ids), key))
    rows, _ = fitting.sampled(rows, label, [key, text, label], each)
    model = fitting.fit(rows, text, label, key, [0, 1], SHAPE)
    # The sample has the labels about evenly; the bias is moved to their shares among all labelled rows.
    for k in (0, 1):
        model.bias[k] += model.temperature * _log_ratio(share.get(k, 1.0), max(share.values()))
    return model


def _log_ratio(part: float, most: float) -> float:
    from math import log

    return log(most / part)


def score(docs: DataFrame, model: SubwordModel | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold)."""
    if model is None:
        found, likely = docs.select(F.struct("*").alias("row")), F.lit(1.0)
    else:
        found, likely = fitting.scored(docs, text, model), F.col("p")[1]
    return fitting.unpacked(found, docs.columns, score=likely, predicted=(likely >= threshold).cast("int"))


def learned_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return labels.where(fitting.remainder(key, FOLDS) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: scores every text of ``documents``; labels of every fifth key by crc32 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", (fitting.remainder("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
