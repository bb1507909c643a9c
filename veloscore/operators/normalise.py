"""P1, normaliser argument: fitted in one mergeable pass, stored with the network, applied as literals.

Both routes and the SQL text apply a network's normaliser themselves (``Model.with_normaliser``), so
it is published and loaded with the network and no scoring job can forget it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloscore.functions.columns import is_missing
from veloscore.sources.model_table import MAX_UNITS, NORMALISERS, Normaliser

#: Vectors up to this wide are summed up as one row of aggregates; wider ones as a row a feature.
UNROLLED = 64


def _statistics(x: Column) -> list[Column]:
    """Count, mean, deviation, least and greatest of what is neither NULL nor NaN. Spark merges each
    from partial results; the deviation from central moments, which do not cancel."""
    x = F.when(~is_missing(x), x)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"),
            F.min(x).alias("least"), F.max(x).alias("most")]


def feature_statistics(df: DataFrame, features_col: str = "features", width: int | None = None) -> DataFrame:
    """One row a feature: ``feature`` (from 0), ``n``, ``mean``, ``deviation``, ``least``, ``most``.

    The statistics of a feature that has no value are NULL, its ``n`` 0. ``width`` (the network's
    inputs) puts vectors of up to UNROLLED features into one aggregate without a shuffle by feature.
    """
    f = F.col(features_col)
    if not isinstance(df.schema[features_col].dataType, T.ArrayType):
        return df.agg(*_statistics(f.cast("double"))).select(F.lit(0).alias("feature"), "*")
    f = f.cast(T.ArrayType(T.DoubleType()))
    if width is not None and width <= UNROLLED:
        each = [F.struct(F.lit(i).alias("feature"), *_statistics(F.get(f, F.lit(i)))) for i in range(width)]
        return df.agg(F.array(*each).alias("each")).select(F.inline("each"))
    long = df.select(F.posexplode(f).alias("feature", "x"))
    return long.groupBy("feature").agg(*_statistics(F.col("x")))


def fit_normaliser(df: DataFrame, kind: str = "standardise", features_col: str = "features",
                   width: int | None = None, low: float = 0.0, high: float = 1.0) -> Normaliser:
    """A normaliser of every feature of ``df``: ``standardise`` to mean 0 and deviation 1, or
    ``minmax`` to ``low..high``. One job; a row a feature reaches the driver.

    A feature that is constant, or has no value at all, becomes 0 (``minmax``: ``low``).
    """
    if kind not in NORMALISERS:
        raise ValueError(f"unknown normaliser {kind!r}")
    if not low < high:
        raise ValueError(f"empty range {low}..{high}")
    rows = feature_statistics(df, features_col, width).orderBy("feature").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} features")
    if not rows:
        raise ValueError("no features: the table is empty or holds no vector")
    if kind == "standardise":
        shift, spread, to, offset = [r["mean"] for r in rows], [r["deviation"] for r in rows], 1.0, 0.0
    else:
        shift = [r["least"] for r in rows]
        spread = [None if r["n"] == 0 else r["most"] - r["least"] for r in rows]
        to, offset = high - low, low
    scale = [to / s if s else 0.0 for s in spread]
    return Normaliser(kind, np.array([s or 0.0 for s in shift]), np.array(scale), offset)
