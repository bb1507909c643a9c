"""Split a row into label and feature columns, tag rows with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_features(df: DataFrame, label_from: int = 0, label_to: int = 0, *,
                   features_col: str = "features", vector: bool | None = None,
                   keep: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The inclusive column range ``[label_from, label_to]`` (by position) is the label,
    every other column a feature.

    Labels keep their names and types. Features become one DOUBLE column when there is a single
    feature (``vector=False``), else an ``ARRAY<DOUBLE>`` in column order. ``keep`` carries extra
    columns through (they are neither label nor feature); ``exclude`` drops columns from the
    positional split (e.g. a corrupt-record column).
    """
    cols = [c for c in df.columns if c not in exclude and c not in keep]
    if not 0 <= label_from <= label_to < len(cols):
        raise ValueError(f"label range {label_from}..{label_to} outside columns {cols}")
    labels = cols[label_from:label_to + 1]
    feats = cols[:label_from] + cols[label_to + 1:]
    if not feats:
        raise ValueError("no feature columns left after the label range")
    if vector is None:
        vector = len(feats) != 1
    if not vector and len(feats) != 1:
        raise ValueError(f"{len(feats)} feature columns cannot form a scalar feature")
    fcol = (F.array(*[F.col(c).cast("double") for c in feats]) if vector
            else F.col(feats[0]).cast("double"))
    return df.select(*keep, *labels, fcol.alias(features_col))


def tag_key(df: DataFrame, key: str | Column = "Predicted", col: str = "key") -> DataFrame:
    """Pair each row with a key (the reference uses the constant ``"Predicted"``; P2b uses
    ``"Occ_Predicted"`` when the label is the scored value). Any column expression works."""
    return df.withColumn(col, key if isinstance(key, Column) else F.lit(key))
