"""K1, K2, A1: save predictions, show a bounded head, count what was scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloscore.functions.columns import col, first_element


def write_predictions(df: DataFrame, path: str, fmt: str = "text", line_col: str = "line",
                      mode: str = "errorifexists") -> str:
    """K1: write predictions, one part file per partition, like a text save of the pairs.

    ``text`` writes the report line only; ``csv`` and ``parquet`` write every column.
    """
    if fmt == "text":
        df.select(line_col).write.mode(mode).text(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return path


def show_lines(df: DataFrame, n: int = 20, line_col: str = "line",
               order_col: str | None = "row_no") -> list[str]:
    """K2: print the first ``n`` report lines. Bounded: ``n`` rows reach the driver (a top-n
    per partition, merged), never the whole result."""
    head = df.orderBy(order_col).limit(n) if order_col else df.limit(n)
    lines = [r[0] for r in head.select(line_col).collect()]
    for line in lines:
        print(line)
    return lines


def rounded_sum(c: str | Column, digits: int = 8) -> Column:
    """Order-independent sum: each value rounded to ``digits`` and added as a decimal, so the
    result does not depend on how rows are split into partitions."""
    return F.sum(F.round(col(c), digits).cast(f"decimal(30,{digits})")).cast("double")


def scored_count(df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """A1: one row ``records, scored, prediction_sum`` (the sum is over the first output of a
    multi-output network).

    Aggregates over the prediction itself: a plain ``df.count()`` lets column pruning drop the
    prediction, so nothing would be scored. Partial aggregation per task, one final row.
    """
    vec = isinstance(df.schema[prediction_col].dataType, T.ArrayType)
    p = first_element(prediction_col, vec)
    return df.agg(F.count(F.lit(1)).alias("records"), F.count(p).alias("scored"),
                  rounded_sum(p).alias("prediction_sum"))
