"""The corpus pipeline: quality filter, near-dedup, decontamination, redaction, tokenization.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of their documents, whatever those are called: a
row travels as one struct beside the id and the text that the operators see.  Null texts count as empty, and an
empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm import bpe, decontam, neardup, pii, quality
from wareflow.llm.shared import dealt_join, saved


def _carried(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", *more)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; rejected ones go.

    Empty and null texts are scored like others, by the labels' shares alone.  Equal texts share their fate.
    """
    model = quality.fit(docs, quality.learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(_carried(docs), model).where("predicted = 1").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Rows are told apart by id and text: of rows with one id, those that are near copies of a kept text go and the
    others stay; of rows equal in both, one stays.  Texts without words, null ones too, are no copies of each other
    and all stay.  A row without an id stays where no row of its group has an id, one a group.
    """
    key = ["no_id", "id", "t"]
    named = [F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "t"]
    found = neardup.groups(docs, size=5, percent=80).where("n_shingles > 0")
    sizes = found.groupBy(*named).agg(F.count("*").alias("rows"), F.bool_or("chosen").alias("repeated"))
    changed = saved(sizes.where("not repeated or rows > 1"))
    total = found.count()
    number = F.col("doc_id").cast("long")
    rows = _carried(docs, number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64("text").alias("t"))
    # Of a row that is repeated often each task keeps one before they meet.
    kept = dealt_join(rows, changed.drop("repeated"), key, total, "left_anti").select("row")
    again = changed.where("repeated")
    if not again.isEmpty():
        once = dealt_join(rows, again.drop("repeated"), key, total, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        kept = kept.union(once.select("row"))
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty and null texts hold none, and repeated rows share their fate."""
    found = decontam.matched(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts is replaced by its kind, and n_chars, where there is one, follows.

    Null texts stay null.
    """
    found = pii.candidates(_carried(docs))
    model = pii.learn(saved(found.select("candidates")))
    redacted = pii.redact(pii.decide(found, model))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(row.alias("row")).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to; empty and null texts have no tokens."""
    path = bpe.default_path()
    # Workers still hold what earlier stages left them, so they remember less here.
    both = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, kept=150_000), path, kept=150_000)
    return both.select("doc_id", "lang", "source", "ids", *bpe.digests(both))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned stages have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
