"""Sources and sinks of input data and models."""

from veloscore.sources.model_table import (MODEL_SCHEMA, Layer, Model, demo_scalar_model,
                                           demo_vector_model, load_model, publish_model,
                                           read_model_table)
from veloscore.sources.series import (SERIES_SCHEMA, epoch_seconds, read_series,
                                      series_from_table, write_series_csv)

__all__ = ["MODEL_SCHEMA", "Layer", "Model", "demo_scalar_model", "demo_vector_model",
           "load_model", "publish_model", "read_model_table", "SERIES_SCHEMA", "epoch_seconds",
           "read_series", "series_from_table", "write_series_csv"]
