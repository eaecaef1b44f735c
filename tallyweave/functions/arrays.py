"""Array columns to rows, and values named inside an expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: Sequence[str], array: Column | str, element: str, place: str = "place") -> DataFrame:
    """One row per element, with its place.

    Spark guards a plain explode by a filter on the array's size, which evaluates a computed array
    a second time. The outer form has no such filter; rows without elements are dropped after it.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, element))
    return rows.where(F.col(place).isNotNull())


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The expression ``body`` makes of a value that is evaluated once, however often it is used there.

    Spark merges a column that only one expression reads into that expression, and evaluates it there as often as an array function
    runs its body or the body names it.
    """
    return F.get(F.transform(F.array(value), body), 0)
