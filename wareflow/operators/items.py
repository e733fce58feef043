"""Steps that prepare items: category, price, translation, words, numbers, keywords, defaults, titles, templates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions import text as T

UNMAPPED = "unmapped"


def _beside(items: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    """The struct column ``row`` as columns, with those of ``made``, which replace columns of their names."""
    taken = {name.lower() for name in made}
    names = [f.name for f in items.schema["row"].dataType.fields if f.name.lower() not in taken]
    return items.select(*[F.col("row")[n].alias(n) for n in names], *[value.alias(name) for name, value in made.items()])


def map_category(items: DataFrame, mapping: DataFrame, column: str, target: str = "category", model=None) -> DataFrame:
    """Step A: the category of each item by a table (src, dst); a model's for the others, ``unmapped`` without either.

    Spark picks a broadcast join by the table's size; a mapping has one row a source category, and of several the
    least counts.  The model sees each unmapped value once; where it fails the item is unmapped, and with a model the
    column ``<target>_error`` says why.
    """
    table = mapping.groupBy("src").agg(F.min("dst").alias("dst"))
    rows = items.select(F.struct("*").alias("row"))
    found = rows.join(table, F.col("row")[column] == F.col("src"), "left")
    if model is None:
        return _beside(found, {target: F.coalesce("dst", F.lit(UNMAPPED))})
    unknown = items.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct().join(table.select(F.col("src").alias("text")), "text", "left_anti")
    guessed = model.apply(unknown, ["text"], "made").select("text", F.col("made.result").alias("guess"), F.col("made.error").alias("guess_error"))
    both = found.join(guessed, F.col("row")[column] == F.col("text"), "left")
    return _beside(both, {target: F.coalesce("dst", "guess", F.lit(UNMAPPED)), f"{target}_error": F.col("guess_error")})


def tier_multiplier(price: Column, tiers: Iterable[tuple[str, str, str]]) -> Column:
    """The multiplier of the tier [low, high) that a price is in; null outside all tiers."""
    chosen = F.lit(None).cast("decimal(9,4)")
    for low, high, times in tiers:
        chosen = F.when((price >= F.lit(Decimal(low))) & (price < F.lit(Decimal(high))), F.lit(Decimal(times)).cast("decimal(9,4)")).otherwise(chosen)
    return chosen


def convert_price(price: Column, rate: str, tiers: Iterable[tuple[str, str, str]]) -> Column:
    """Step B: price in the target currency, two places; null for null prices and those outside all tiers."""
    exact = price.cast("decimal(18,4)")
    return (exact * F.lit(Decimal(rate)).cast("decimal(9,4)") * tier_multiplier(exact, tiers)).cast("decimal(18,2)")


def _price_bucket(price: Column) -> Column:
    """Four buckets an octave; what is under 1/128 is in the first one."""
    return F.floor(F.log2(F.greatest(price.cast("double"), F.lit(2.0**-7))) * 4).cast("int")


def convert_price_by_table(items: DataFrame, tiers: DataFrame, price: str, rate: str, target: str) -> DataFrame:
    """Step B with the tiers in a table (lo, hi, mult) of any size; at most one tier may hold a price.

    Tiers are listed under each bucket that they reach into, so prices find theirs by an equality join.
    """
    lo, hi = F.col("lo"), F.col("hi")
    listed = tiers.where(lo < hi).select("lo", "hi", "mult", F.explode(F.sequence(_price_bucket(lo), _price_bucket(hi))).alias("bucket"))
    rows = items.select(F.struct("*").alias("row"), F.col(price).alias("price"), _price_bucket(F.col(price)).alias("bucket"))
    found = rows.join(listed, (rows["bucket"] == listed["bucket"]) & (F.col("price") >= lo) & (F.col("price") < hi), "left")
    exact = F.col("price").cast("decimal(18,4)") * F.lit(Decimal(rate)).cast("decimal(9,4)") * F.col("mult")
    return _beside(found, {target: exact.cast("decimal(18,2)")})


def translate(items: DataFrame, column: str, model, target: str) -> DataFrame:
    """Step C: translated text; the model sees each distinct text once."""
    texts = items.select(F.col(column).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    table = model.apply(texts, ["_text"], "_made").select("_text", F.col("_made.result").alias(target), F.col("_made.error").alias(f"{target}_error"))
    return items.join(table, items[column].eqNullSafe(table["_text"]), "left").drop("_text")


def keyword_filter(items: DataFrame, column: str, keywords: Iterable[str]) -> DataFrame:
    """Step G: ``hit`` (the keyword found) and ``keep``; filter on it before any model runs."""
    hit = T.keyword_hit(F.col(column), keywords)
    return items.withColumn("hit", hit).withColumn("keep", F.col("hit") == "")


def fill_defaults(items: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Step H: defaults for nulls and empty strings."""
    kinds = dict(items.dtypes)
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c), F.lit(v).cast(kinds[c])) for c, v in defaults.items()}
    return items.withColumns(filled)


def dedup_titles(items: DataFrame, key: str, title: str) -> DataFrame:
    """Step I: of items whose titles are equal but for case and spaces, the one with the smallest key.

    Items without a title, null or blank, are no duplicates of each other and all stay.  A minimum by group, which
    Spark sums up before the shuffle: a title of a third of all items is no hot spot.
    """
    norm = F.coalesce(T.normalized_title(F.col(title)), F.lit(""))
    rows = items.select(F.struct(*items.columns).alias("_row"), F.col(key).alias("_key"), norm.alias("_norm"))
    first = rows.where("_norm != ''").groupBy("_norm").agg(F.min_by("_row", "_key").alias("_row"))
    return first.select("_row.*").unionByName(rows.where("_norm = ''").select("_row.*"))


def append_template(description: Column, *lines: Column) -> Column:
    """Step J: the description and the template's lines, those that are null left out."""
    return F.concat_ws("\n", description, *lines)
