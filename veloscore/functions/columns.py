"""Column-level helpers shared by both scoring routes, the report and the oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    """NULL or NaN: such a feature gives a NULL prediction on every route."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def any_missing(arr: str | Column) -> Column:
    """A NULL array, or an array with a NULL or NaN element.

    ``array_contains`` treats NaN as equal to NaN and gives NULL when an element is NULL and no
    NaN is found; both mean "missing". Unlike a lambda it stays in whole-stage codegen.
    """
    arr = col(arr)
    return arr.isNull() | F.coalesce(F.array_contains(arr, float("nan")), F.lit(True))


def to_int(c: str | Column, digits: int = 6) -> Column:
    """Truncate toward zero to INT, as the reference's int read of a prediction does.

    Rounded to ``digits`` first so that 41.99999999999999 and 42.0 (the same value summed in a
    different order) truncate alike. NaN and values outside INT give NULL (``try_cast``); the
    double stays available beside it.
    """
    return F.round(col(c), digits).try_cast("int")


def first_element(c: str | Column, is_array: bool) -> Column:
    """The first element of a vector output, or the scalar itself."""
    return F.element_at(col(c), 1) if is_array else col(c)
