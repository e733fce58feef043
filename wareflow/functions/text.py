"""Text expressions of the item steps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once a row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def replace_words(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements in the order given; a rule sees what earlier ones made."""
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_numbers(text: Column) -> Column:
    """Full-width digits become ASCII, marks of currency before or after a number go, and so do thousands marks.

    A comma is a thousands mark between a digit and exactly three digits.
    """
    text = F.translate(text, "０１２３４５６７８９，．", "0123456789,.")
    text = F.regexp_replace(text, r"[¥￥$€] *([0-9])", "$1")
    text = F.regexp_replace(text, r"([0-9]) *[円元]", "$1")
    return F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def first_number(text: Column) -> Column:
    """The first number of a cleaned text as decimal(38,4), further places rounded; null without one, or with more digits than fit."""
    return F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("decimal(38,4)")


def keyword_hit(text: Column, keywords: Iterable[str]) -> Column:
    """The first of the keywords, taken literally and without regard to case, in the text; empty without any."""
    words = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in keywords if w]
    if not words:
        return F.lit("")
    return F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i)({'|'.join(words)})", 1))


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def distinct_words(title: Column) -> Column:
    """The title without repeated words; the first of each stays."""
    return F.array_join(F.array_distinct(F.filter(F.split(title, " "), lambda w: w != "")), " ")
