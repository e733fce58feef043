"""Helpers for array work in DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once a row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.when(last.isNull(), x).otherwise(combine(last, x))))

    return F.aggregate(numbers, F.array().cast("array<long>"), step)


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative ``combine`` over an array of long; in chunks, as each step copies what its chunk has so far."""

    def chunked(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int"))
        chunks = F.transform(starts, lambda k: _running(F.slice(a, k * _CHUNK + 1, F.lit(_CHUNK)), combine))

        def shifted(c: Column) -> Column:
            before = _running(F.transform(c, lambda x: F.element_at(x, -1)), combine)
            return let(before, lambda b: F.flatten(F.transform(c, lambda x, k: F.transform(x, lambda y: F.when(k > 0, combine(F.get(b, k - 1), y)).otherwise(y)))))

        return let(chunks, shifted)

    return let(numbers, lambda a: F.when(F.size(a) == 0, F.array().cast("array<long>")).when(F.size(a) <= _CHUNK, _running(a, combine)).otherwise(chunked(a)))


def running_sums(numbers: Column) -> Column:
    """The running sums of an array of long."""
    return running(numbers, lambda a, b: a + b)
