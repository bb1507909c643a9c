"""Series sources (S1, S2): delimited or Parquet input read with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reference input: headerless ``epoch seconds,value`` lines.
SERIES_SCHEMA = "unix_time BIGINT, value DOUBLE"

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def read_series(spark: SparkSession, path: str | list[str], schema: str | T.StructType = SERIES_SCHEMA,
                *, fmt: str = "csv", sep: str = ",", header: bool = False, mode: str = "FAILFAST",
                corrupt_column: str | None = None, skip: int = 0) -> DataFrame:
    """S1 + S2: scan and parse in one step; the schema is explicit, never inferred.

    ``mode`` is the CSV parse mode: ``FAILFAST`` stops on a malformed line, ``PERMISSIVE``
    turns bad cells into NULL and, with ``corrupt_column``, keeps the raw line there.
    ``DROPMALFORMED`` drops such lines. Blank lines are skipped; an empty cell is NULL.

    ``skip`` leaves out the first lines of every file, blank ones counted, as many as it says (see
    :func:`skip_lines`); the rest is parsed as without it.
    """
    if skip < 0:
        raise ValueError("skip must not be negative")
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
    if fmt != "csv":
        raise ValueError(f"unsupported series format {fmt!r}")
    if corrupt_column:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        if corrupt_column not in st.fieldNames():
            st = T.StructType(st.fields + [T.StructField(corrupt_column, T.StringType())])
        schema = st
    if skip:
        if header:
            raise ValueError("skip and header exclude each other: count the header among the lines to skip")
        return _parsed(skip_lines(spark, path, skip), schema, sep, mode, corrupt_column)
    reader = (spark.read.schema(schema).option("sep", sep).option("header", header)
              .option("mode", mode))
    if corrupt_column:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.csv(path)


def skip_lines(spark: SparkSession, path: str | list[str], skip: int) -> DataFrame:
    """The lines of text files (column ``line``) without the first ``skip`` of every file.

    Files stay splittable. Where a line begins is known as its block's start and, in one reading of the
    same splits, its number in the task; a line of the first block is therefore among the first
    ``skip`` of its file if its number is. One pass finds, for each file, the last line to leave out:
    each task keeps ``skip`` lines of a file at most before anything is shuffled. The second pass
    compares. Should the lines to skip reach into a file's second block, they are found there too.
    """
    text = spark.read.text(path if isinstance(path, list) else [path]).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    place = F.struct("start", "number")
    order = Window.partitionBy("file").orderBy("start", "number")
    heads = text.select("file", "start", "number", F.row_number().over(order).alias("nth")).where(F.col("nth") <= skip)
    last = heads.groupBy("file").agg(F.max(place).alias("until"))
    kept = text.join(last.withColumnRenamed("file", "skipped_file"), F.col("file") == F.col("skipped_file"), "left")
    return kept.where(F.col("until").isNull() | (place > F.col("until"))).select("line")


def _parsed(lines: DataFrame, schema: str | T.StructType, sep: str, mode: str, corrupt_column: str | None) -> DataFrame:
    """Lines as rows of ``schema``, by the same parser and modes as files."""
    if mode not in ("FAILFAST", "PERMISSIVE", "DROPMALFORMED"):
        raise ValueError(f"unknown mode {mode!r}")
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    lines = lines.where(F.length(F.trim("line")) > 0)
    own = corrupt_column
    if mode == "DROPMALFORMED":  # a whole-line parser has no such mode: drop what it reports
        own = "__malformed"
        st = T.StructType(st.fields + [T.StructField(own, T.StringType())])
    options = {"sep": sep, "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE"}
    if own:
        options["columnNameOfCorruptRecord"] = own
    rows = lines.select(F.from_csv("line", st.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("row"))
    if mode == "DROPMALFORMED":
        rows = rows.where(F.col(f"row.{own}").isNull())
    return rows.select(*[F.col(f"row.`{f}`").alias(f) for f in st.fieldNames() if f != "__malformed"])


def epoch_seconds(ts: str | Column, ntz: bool = True) -> Column:
    """Whole epoch seconds (floor) of a timestamp, independent of the session time zone for
    ``TIMESTAMP_NTZ`` input."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if not ntz:
        return F.unix_seconds(c)
    # unix_timestamp reads a TIMESTAMP_NTZ as UTC wall time (no zone lookup) and truncates
    # toward zero; before 1970 a fractional second is floored instead, as epoch_us(ts) // 1e6.
    secs = F.unix_timestamp(c)
    sec_field = F.date_part(F.lit("SECOND"), c)
    before_epoch_frac = (c < F.expr(_EPOCH_NTZ)) & (sec_field != F.floor(sec_field))
    return F.when(before_epoch_frac, secs - F.lit(1)).otherwise(secs)


def series_from_table(df: DataFrame, ts_col: str = "ts", value_col: str = "value",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """A time series ``(unix_time, value)`` from a table with a timestamp column (e.g. events),
    plus any columns in ``keep`` carried alongside."""
    ntz = isinstance(df.schema[ts_col].dataType, T.TimestampNTZType)
    return df.select(*keep, epoch_seconds(ts_col, ntz).alias("unix_time"),
                     F.col(value_col).cast("double").alias("value"))


def write_series_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """Write a series as headerless delimited text (the reference's input format)."""
    df.write.mode("errorifexists").option("sep", sep).option("header", False).csv(path)
    return path


def check_series(df: DataFrame) -> dict[str, int]:
    """Parse every column once and return ``{"rows": n, <column>: non-NULL count, ...}``.

    ``count()`` alone reads no column, so a ``FAILFAST`` CSV with malformed lines would pass it;
    this aggregate touches each column and fails on them. One partial aggregate per task.
    """
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return row.asDict()
