"""veloscore: batch scoring of tables with feed-forward networks on Spark."""

from veloscore.operators import (report, row_index, score, score_batched, score_native,
                                 split_features, tag_key)
from veloscore.plans.jobs import (score_and_count, score_and_report, scored, timed_run,
                                  timed_runs)
from veloscore.plans.sinks import scored_count, show_lines, write_predictions
from veloscore.sources import (Model, demo_scalar_model, demo_vector_model, load_model,
                               publish_model, read_series, series_from_table)

__all__ = ["report", "row_index", "score", "score_batched", "score_native", "split_features",
           "tag_key", "score_and_count", "score_and_report", "scored", "timed_run", "timed_runs",
           "scored_count", "show_lines", "write_predictions", "Model", "demo_scalar_model",
           "demo_vector_model", "load_model", "publish_model", "read_series", "series_from_table"]
