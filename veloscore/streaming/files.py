"""Score series files as they arrive in a folder.

Same operators as the batch jobs (S2 parse, P1 split, P2 key, M1 score, P4/P6b report), run per
micro-batch by Structured Streaming. Every operator is row-local, so the stream needs no state
and no watermark. The row-numbered report (P5/P6) needs a global order over all input and is a
batch-only job; a stream reports by time (P6b) instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veloscore.operators.reporting import report
from veloscore.plans.jobs import scored
from veloscore.sources.model_table import Model
from veloscore.sources.series import SERIES_SCHEMA


def read_series_stream(spark: SparkSession, input_dir: str, schema=SERIES_SCHEMA, *,
                       sep: str = ",", mode: str = "FAILFAST",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming series source: headerless delimited files appearing in ``input_dir``."""
    reader = (spark.readStream.schema(schema).option("sep", sep).option("header", False)
              .option("mode", mode))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(input_dir)


def score_stream(spark: SparkSession, input_dir: str, model: Model, *, report_by_time: bool = True,
                 schema=SERIES_SCHEMA, label_from: int = 0, label_to: int = 0,
                 key: str = "Predicted", route: str = "native", batch_size: int = 5,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of predictions (``report_by_time=False``: labels, features, key and
    prediction) or of time-keyed report rows ``unix_time, key, predicted, actual, line``."""
    stream = read_series_stream(spark, input_dir, schema, max_files_per_trigger=max_files_per_trigger)
    s = scored(stream, model, label_from=label_from, label_to=label_to, key=key, route=route,
               batch_size=batch_size)
    return report(s, by_time=True) if report_by_time else s


def run_available(stream: DataFrame, output_path: str, checkpoint_path: str,
                  fmt: str = "parquet") -> StreamingQuery:
    """Process every file present now, in as many micro-batches as the source allows, then
    stop. The checkpoint (in the shared folder) makes a restarted query resume where it left
    off: files already committed are not scored twice."""
    q = (stream.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start(output_path))
    q.awaitTermination()
    return q
