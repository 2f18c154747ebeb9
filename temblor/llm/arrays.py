"""Running sums of arrays, by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PIECE = 512


def _fold(numbers: Column, start: Column) -> Column:
    """``start`` and the sums up to each number: one element more than ``numbers``."""
    return F.aggregate(numbers, F.array(start), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def running_sums(numbers: Column) -> Column:
    """The sum up to each element of an array<bigint> without nulls; an empty array stays empty.

    An array cannot grow without being copied, so a plain fold takes the square of its length. Here
    pieces of ``_PIECE`` elements are folded, each from the sum of those before it.
    """
    pieces = F.transform(
        F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers), F.lit(_PIECE))).otherwise(F.array().cast("array<int>")),
        lambda at: F.slice(numbers, at, F.lit(_PIECE)))
    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda s, x: s + x))
    before = _fold(totals, F.lit(0).cast("bigint"))
    inside = F.zip_with(pieces, F.slice(before, F.lit(1), F.size(totals)), lambda p, start: F.slice(_fold(p, start), F.lit(2), F.size(p)))
    return F.flatten(inside)
