"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection.

A text that is null or has no letter gets ``und`` with score 0 and is rejected.  Others get the likeliest
language of all that are labelled, its calibrated probability, and ``rejected`` where that is under the level at which held-back rows are
right 99 times in 100.  Without any labelled row everything is ``und``.  Columns of the input are kept; those added
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm import fitting
from wareflow.llm.shared import within_spent
from wareflow.llm.subword import Shape, SubwordModel

SHAPE = Shape(lower=True, repeats=False)
#: Rows of each language that training reads at most; fewer with more than ten languages (fitting.MAX_ROWS).
SAMPLE_EACH = 600
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@within_spent
def fit(docs: DataFrame, each: int = SAMPLE_EACH, key: str = "doc_id", text: str = "text", label: str = "lang") -> SubwordModel | None:
    """A model of the labels of ``docs`` from ``each`` rows of a label at most; None without any."""
    sample, share = fitting.sampled(docs, label, [key, text, label], each)
    if not share:
        return None
    return fitting.fit(sample, text, label, key, sorted(share), SHAPE)


def identify(docs: DataFrame, model: SubwordModel | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    if model is None:
        found = docs.select(F.struct("*").alias("row"))
        return fitting.unpacked(found, docs.columns, lang_pred=F.lit(UNKNOWN), score=F.lit(0.0), rejected=F.lit(True))
    found = fitting.scored(docs, text, model)
    letters = F.coalesce(F.col("row")[text].rlike(r"\p{L}"), F.lit(False))
    names, best = F.array(*[F.lit(c) for c in model.classes]), F.array_max("p")
    return fitting.unpacked(
        found,
        docs.columns,
        lang_pred=F.when(letters, F.element_at(names, F.array_position("p", best).cast("int"))).otherwise(UNKNOWN),
        score=F.when(letters, best).otherwise(0.0),
        rejected=~letters | (best < model.reject_below),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the language of every text of ``documents``; every fourth key by crc32 is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(fitting.remainder("doc_id", FOLDS) != HELD_OUT))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fitting.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
