"""P1 with ``regression=False``: class labels through a stable dictionary, never collected.

The dictionary is the sorted distinct labels, numbered from 0 by the distributed row index, so the
same labels get the same numbers in any run and on any partitioning. It is a table: encoding joins
it, and only the number of classes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscore.operators.indexing import row_index
from veloscore.session import scratch_path

#: One-hot labels are arrays on every row; beyond this many classes use the index.
MAX_ONE_HOT = 10_000

_LABEL, _INDEX = "label", "label_index"


def label_dictionary(df: DataFrame, label_col: str, path: str | None = None) -> DataFrame:
    """``label, label_index``: the distinct labels of ``df`` in ascending order, numbered from 0.

    NULL is no label. Written as Parquet to ``path`` (a new one under the shared scratch folder if
    None) and read back, so the numbers stay what they are however often it is used.
    """
    labels = df.select(F.col(label_col).alias(_LABEL)).where(F.col(_LABEL).isNotNull()).distinct()
    path = path or scratch_path(df.sparkSession, "labels")
    labels.write.parquet(path)
    numbered = row_index(df.sparkSession.read.parquet(path), [_LABEL], _INDEX, unique=True)
    numbered.select(_LABEL, (F.col(_INDEX) - 1).alias(_INDEX)).write.parquet(f"{path}-index")
    return df.sparkSession.read.parquet(f"{path}-index")


def encode_labels(df: DataFrame, dictionary: DataFrame, label_col: str, *, one_hot: bool = False,
                  unknown: str = "null") -> DataFrame:
    """``df`` with ``label_index`` (BIGINT) and, with ``one_hot``, ``label_one_hot`` (ARRAY<DOUBLE>).

    A label that the dictionary does not hold has a NULL index and a one-hot of zeros
    (``unknown="null"``), or fails the job (``unknown="error"``); a NULL label has both NULL. The
    dictionary is joined by key: broadcast only if Spark's own size limit allows, split by AQE where
    one label has many rows.
    """
    if unknown not in ("null", "error"):
        raise ValueError(f"unknown={unknown!r}")
    key = "__label_key"
    own = dictionary.select(F.col(_LABEL).alias(key), F.col(_INDEX))
    out = df.join(own, F.col(label_col) == F.col(key), "left")
    index = F.col(_INDEX)
    if unknown == "error":
        lost = F.col(label_col).isNotNull() & index.isNull()
        index = F.when(lost, F.raise_error(F.concat(F.lit("unknown label: "), F.col(label_col).cast("string"))).cast("bigint")).otherwise(index)
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], index.alias(_INDEX))
    if not one_hot:
        return out
    n = dictionary.count()
    if n > MAX_ONE_HOT:
        raise ValueError(f"{n} classes, over the limit ({MAX_ONE_HOT}) for one-hot labels")
    classes = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    hot = F.transform(classes, lambda i: F.when(i.eqNullSafe(F.col(_INDEX)), 1.0).otherwise(0.0))
    return out.withColumn("label_one_hot", F.when(F.col(label_col).isNotNull(), hot))


def decode_labels(df: DataFrame, dictionary: DataFrame, index_col: str, out_col: str = "label") -> DataFrame:
    """``df`` with the label of each index (NULL for an index that the dictionary does not hold)."""
    key = "__label_index"
    own = dictionary.select(F.col(_INDEX).alias(key), F.col(_LABEL).alias("__label_value"))
    out = df.join(own, F.col(index_col) == F.col(key), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__label_value").alias(out_col))
