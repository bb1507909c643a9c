"""Blocks of documents that ask and are answered.

Rows are dealt at random, but reproducibly, into blocks. A block asks every bucket of a key space
at most one question, however often a key occurs in it, so a key that a third of all rows hold
costs one entry a block. A bucket answers all blocks; blocks read their own answers.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscore.session import checkpoint_root

#: Narrow rows that a partition holds at least.
PACKED = 1 << 14


def parts(spark: SparkSession) -> int:
    """As many blocks, and buckets, as the session has shuffle partitions: one holds what the
    cluster's owner lets one task read, and questions are no more rows than a shuffle has pieces."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder; no lost executor takes it away."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many rows fill; each of them would be files of every shuffle."""
    return df.coalesce(max(1, -(-rows // PACKED)))


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written, and packed by its number of rows: for tables that may be small, of narrow rows."""
    df = written(df, name)
    return packed(df, df.count())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, for what is read more than once or in part, or goes into
    later rounds: a checkpoint keeps the size that was estimated of its joins, the product of their
    sides, and the product of a loop's products has millions of digits; files have the size they have."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_block(df: DataFrame, by: Column, n: int) -> DataFrame:
    return df.withColumn("block", F.pmod(by, F.lit(n)).cast("int"))


def in_order(table: pa.Table, *keys: str) -> pa.Table:
    """The rows in an order that does not depend on how they arrived."""
    return table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]))
