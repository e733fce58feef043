"""Rule stand-ins of the text sub-stages: main and secondary terms, search title, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions.text import let

SPLIT = r"[\s.,]+"


def counted(text: Column, least: int = 4) -> Column:
    """The terms of a text and their numbers, most frequent first and ties by the smaller term: array of (times, term).

    Sorted words make runs, whose ends say how long they are; all within the row.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: F.length(w) >= least)

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        less = lambda p, k, at: p - F.coalesce(F.get(at, k + 1), F.size(s))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(less(p, k, at).alias("less"), F.get(s, p).alias("term"))))

    ordered = F.sort_array(let(F.sort_array(words), runs))
    return F.transform(ordered, lambda x: F.struct((-x["less"]).cast("long").alias("times"), x["term"].alias("term")))


def top_terms(docs: DataFrame, key: str, text: str, main: int = 2, secondary: int = 3, least: int = 4) -> DataFrame:
    """(key, rank, term, times, role): the most frequent terms of a text; ties go to the smaller term.  Nothing is shuffled."""
    top = F.slice(counted(F.col(text), least), 1, main + secondary)
    ranked = docs.select(key, F.posexplode(top).alias("at", "t"))
    rank = (F.col("at") + 1).cast("long")
    return ranked.select(key, F.col("t.term").alias("term"), F.col("t.times").alias("times"), rank.alias("rank"), F.when(rank <= main, "main").otherwise("secondary").alias("role"))


def search_title(brand: Column, terms: Column, most: int = 60) -> Column:
    """Brand and terms, cut to so many characters."""
    return F.substring(F.concat_ws(" ", brand, F.array_join(terms, " ")), 1, most)


def tags(terms: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(terms), 1, most)
