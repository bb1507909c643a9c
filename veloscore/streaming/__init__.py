"""The scoring pipeline over a file stream (Structured Streaming)."""

from veloscore.streaming.files import read_series_stream, run_available, score_stream

__all__ = ["read_series_stream", "run_available", "score_stream"]
