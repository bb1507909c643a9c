"""Integer prediction, the input value as "actual", one text line per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloscore.functions.columns import first_element, to_int

#: The reference's report line formats.
ROW_LINE = "Row:%d ==> %s:%d - Actual:%d"
TIME_LINE = "Unix-time:%d ==> %s:%d - Actual:%d"


def report(df: DataFrame, *, by_time: bool = False, row_col: str = "row_no",
           time_col: str = "unix_time", key_col: str = "key", prediction_col: str = "prediction",
           features_col: str = "features", carry: tuple[str, ...] = ()) -> DataFrame:
    """Project a scored, indexed frame to the report schema
    ``row_no, unix_time, key, predicted INT, actual INT, line`` (plus ``carry``).

    ``predicted`` is the first output truncated toward zero (P4); ``actual`` is the model's
    input (the first feature) truncated the same way - the reference prints the features of the
    same row as "Actual", nothing is shifted in time. NULLs print as ``null`` in ``line``.
    ``by_time`` (P6b) labels the line with the epoch seconds instead of the row number.
    """
    pred_vec = isinstance(df.schema[prediction_col].dataType, T.ArrayType)
    feat_vec = isinstance(df.schema[features_col].dataType, T.ArrayType)
    predicted = to_int(first_element(prediction_col, pred_vec))
    actual = to_int(first_element(features_col, feat_vec))
    label = F.col(time_col) if by_time else F.col(row_col)
    line = F.format_string(TIME_LINE if by_time else ROW_LINE, label, F.col(key_col),
                           predicted, actual)
    cols = [c for c in (row_col, time_col) if c in df.columns]
    return df.select(*carry, *cols, F.col(key_col), predicted.alias("predicted"),
                     actual.alias("actual"), line.alias("line"))
