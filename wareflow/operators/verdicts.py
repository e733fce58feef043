"""The batch reject scan: batches of four images, strict parsing of verdicts, reject classes and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions.sequence import numbered
from wareflow.functions.text import let

BATCH = 4
#: What is rejected, and what is let through although it looks like that.
REJECT_CLASSES = ("text_only", "decorative_border", "price_or_promo", "store_logo", "seller_stamp", "corner_size_text", "centre_praise_text")
EXCEPTIONS = ("text_on_product", "grading_box", "product_ornament", "qr_mosaic", "held_in_fingers")
SCHEMA = "struct<reject_indices: array<int>, reject_scores: array<double>>"


def batches(images: DataFrame, item: str, order: str | list[str], bucket: Column, size: int = BATCH) -> DataFrame:
    """``images`` with batch and position (from 0) within their item, by ``order``; images of no item are one item's."""
    rows = numbered(images, [item], bucket, [order] if isinstance(order, str) else list(order), "_seq")
    at = F.col("_seq") - 1
    return rows.withColumn("batch", F.floor(at / size).cast("long")).withColumn("position", (at % size).cast("int")).drop("_seq")


#: Escapes, quotes, braces, and what lies between.
_TOKENS = r'(?s)\\.|["{}]|[^"{}\\]+|\\'


def verdict_json(raw: Column) -> Column:
    """The first JSON object in a model's answer to close that has a field reject_indices of its own; null without one.

    Braces are counted, but for those in strings, so objects may be nested either way: the verdict in another object, or
    other objects in the verdict.  Quotes count as strings' within braces only, as prose has single ones.  One pass
    over the tokens: the open objects are a stack of (place of the brace, whether the field was seen).
    """
    tokens = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_TOKENS), F.lit(0))

    def scanned(t: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<place: int, seen: boolean>>").alias("open"),
            F.lit(False).alias("quoted"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        )

        def step(acc: Column, token: Column) -> Column:
            stack, at, searching = acc["open"], acc["at"], acc["last"] < 0
            inside = F.size(stack) > 0
            opens = searching & ~acc["quoted"] & (token == "{")
            closes = searching & ~acc["quoted"] & inside & (token == "}")
            quote = searching & inside & (token == '"')
            named = quote & acc["quoted"] & (F.get(t, at - 1) == "reject_indices") & (F.get(t, at - 2) == '"') & F.coalesce(F.get(t, at + 1).rlike(r"^\s*:"), F.lit(False))
            top = F.get(stack, F.size(stack) - 1)
            below = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
            mark = F.array(F.struct(F.coalesce(top["place"], F.lit(0)).alias("place"), F.lit(True).alias("seen")))
            added = F.array(F.struct(at.alias("place"), F.lit(False).alias("seen")))
            found = closes & top["seen"]
            return F.struct(
                (at + 1).alias("at"),
                F.when(opens, F.concat(stack, added)).when(closes, below).when(named, F.concat(below, mark)).otherwise(stack).alias("open"),
                F.when(quote, ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
                F.when(found, top["place"]).otherwise(acc["first"]).alias("first"),
                F.when(found, at).otherwise(acc["last"]).alias("last"),
            )

        return let(F.aggregate(t, start, step), lambda end: F.when(end["last"] >= 0, F.array_join(F.slice(t, end["first"] + 1, end["last"] - end["first"] + 1), "")))

    return let(tokens, scanned)


def parse(raw: Column) -> Column:
    """The verdict of an answer; null where there is none, it is malformed, or its lists differ in length."""
    found = F.from_json(verdict_json(raw), SCHEMA, {"mode": "PERMISSIVE"})
    indices, scores = found["reject_indices"], found["reject_scores"]
    return F.when(indices.isNotNull() & scores.isNotNull() & (F.size(indices) == F.size(scores)), found)


def flattened(answers: DataFrame, key: str, raw: str, images: str) -> DataFrame:
    """(key, position, score) of each rejected image; positions outside the batch are left out."""
    pairs = F.arrays_zip(F.col("_v.reject_indices"), F.col("_v.reject_scores"))
    rows = answers.withColumn("_v", parse(F.col(raw))).where(F.col("_v").isNotNull()).select(key, F.col(images).alias("_n"), F.explode(pairs).alias("p"))
    found = rows.select(key, "_n", F.col("p.reject_indices").alias("position"), F.col("p.reject_scores").alias("score"))
    return found.where((F.col("position") >= 0) & (F.col("position") < F.col("_n"))).drop("_n")


def rejected(classes: Column, exempt: Column, score: Column, least: float = 0.5) -> Column:
    """Whether an image is rejected: a reject class, no exception, and a score of ``least`` or more."""
    known = F.arrays_overlap(classes, F.array(*map(F.lit, REJECT_CLASSES)))
    let_through = F.arrays_overlap(exempt, F.array(*map(F.lit, EXCEPTIONS)))
    return F.coalesce(known, F.lit(False)) & ~F.coalesce(let_through, F.lit(False)) & (F.coalesce(score, F.lit(0.0)) >= least)


def qualified(scanned: DataFrame) -> DataFrame:
    """``scanned`` (rejected, error) with status: unqualified where the batch failed, whatever it said, else rejected or ok."""
    return scanned.withColumn("status", F.when(F.col("error").isNotNull(), "unqualified").when(F.coalesce("rejected", F.lit(False)), "rejected").otherwise("ok"))


def split(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error.  Write ``rows`` first: a model's column would else run once for each."""
    return rows.where(F.col(error).isNull()), rows.where(F.col(error).isNotNull())
