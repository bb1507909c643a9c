"""The reference's jobs as DataFrame pipelines.

Each pipeline is lazy and narrow except the row index of the report (one shuffle by bucket).
One action per job: the caller's collect/write, a ``noop`` write for timing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veloscore.operators.features import split_features, tag_key
from veloscore.operators.reporting import report
from veloscore.operators.indexing import row_index
from veloscore.operators.scoring import score
from veloscore.plans.sinks import scored_count
from veloscore.sources.model_table import Model


def scored(series: DataFrame, model: Model, *, label_from: int = 0, label_to: int = 0,
           key: str = "Predicted", route: str = "native", batch_size: int = 5,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """split (P1) -> key (P2) -> score (M1); labels, carried columns and features stay on the
    row beside ``key`` and ``prediction`` (P3)."""
    split = split_features(series, label_from, label_to, keep=keep)
    return score(tag_key(split, key), model, route=route, batch_size=batch_size)


def score_and_report(series: DataFrame, model: Model, *, order_by=("unix_time", "value"),
                     by_time: bool = False, label_from: int = 0, label_to: int = 0,
                     key: str = "Predicted", route: str = "native", batch_size: int = 5,
                     time_col: str = "unix_time") -> DataFrame:
    """Index (P5, before scoring so the index job never runs the network) -> split ->
    key -> score -> report (P4, P6 / P6b)."""
    indexed = row_index(series, list(order_by))
    s = scored(indexed, model, label_from=label_from, label_to=label_to, key=key, route=route,
               batch_size=batch_size, keep=("row_no",))
    return report(s, by_time=by_time, time_col=time_col)


def score_and_count(series: DataFrame, model: Model, **kw) -> DataFrame:
    """As J1 without the report: one row ``records, scored, prediction_sum``."""
    return scored_count(scored(series, model, **kw))


def timed_run(pipeline: DataFrame | Callable[[], DataFrame]) -> dict[str, int]:
    """Run the whole pipeline once into the ``noop`` sink (every column is computed,
    unlike ``count()``), with the row count taken by an ``Observation`` in the same pass.

    Given a callable, building the DataFrame is timed too (it may run jobs of its own, like
    the row index's bounds and counts)."""
    t0 = time.perf_counter_ns()
    df = pipeline() if callable(pipeline) else pipeline
    obs = Observation("veloscore_timed")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    observed.write.format("noop").mode("overwrite").save()
    elapsed = (time.perf_counter_ns() - t0) // 1_000_000
    return {"rows": int(obs.get["rows"]), "elapsed_ms": int(elapsed)}


PARTITION_SCHEMA = "partition INT, rows BIGINT, scored BIGINT, wait_ms DOUBLE, elapsed_ms DOUBLE"


def timed_partitions(pipeline: DataFrame | Callable[[], DataFrame], prediction_col: str = "prediction") -> DataFrame:
    """J3, split by task: one row a partition of the pipeline's last stage, with the rows and
    predictions that it gave, the time until its first batch and until its last.

    Lazy: running the result runs the pipeline once, every column of it. The rows stay where they
    are; a partition sends five numbers. Empty partitions give a row of zeros.
    """
    df = pipeline() if callable(pipeline) else pipeline
    at = df.columns.index(prediction_col)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = time.perf_counter_ns()
        rows = scored = 0
        first = None
        for batch in batches:
            first = first or time.perf_counter_ns()
            rows += batch.num_rows
            scored += batch.num_rows - batch.column(at).null_count
        last = time.perf_counter_ns()
        numbers = (TaskContext.get().partitionId(), rows, scored, ((first or last) - begin) / 1e6, (last - begin) / 1e6)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.record_batch([pa.array([n], t) for n, t in zip(numbers, types, strict=True)],
                              names=["partition", "rows", "scored", "wait_ms", "elapsed_ms"])

    return df.mapInArrow(tally, PARTITION_SCHEMA)


def timed_stage(pipeline: DataFrame | Callable[[], DataFrame], prediction_col: str = "prediction") -> dict[str, float]:
    """J3 with the split by task summed up as observed metrics of the same pass: rows, scored,
    partitions, and of their times the least, mean and greatest. Only the metrics reach the driver."""
    t0 = time.perf_counter_ns()
    obs = Observation("veloscore_stage")
    ms = F.col("elapsed_ms")
    observed = timed_partitions(pipeline, prediction_col).observe(
        obs, F.sum("rows").alias("rows"), F.sum("scored").alias("scored"), F.count(F.lit(1)).alias("partitions"),
        F.min(ms).alias("least_ms"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("greatest_ms"))
    observed.write.format("noop").mode("overwrite").save()
    return {**obs.get, "elapsed_ms": (time.perf_counter_ns() - t0) / 1e6}


TIMED_SCHEMA = "iteration INT, rows BIGINT, elapsed_ms BIGINT, cumulative_ms BIGINT, mean_ms DOUBLE"


def timed_runs(pipeline: DataFrame | Callable[[], DataFrame], iterations: int = 3) -> DataFrame:
    """Score the same input ``iterations`` times, nothing cached, so each pass re-reads the
    source. One row per pass: its time, the time since the loop started, and the running mean
    (the last row's ``mean_ms`` is the reference's mean, cold pass included)."""
    if iterations < 1:
        raise ValueError("iterations must be at least 1")
    rows, cumulative = [], 0
    for i in range(1, iterations + 1):
        r = timed_run(pipeline)
        cumulative += r["elapsed_ms"]
        rows.append((i, r["rows"], r["elapsed_ms"], cumulative, cumulative / i))
    return SparkSession.active().createDataFrame(rows, TIMED_SCHEMA)
