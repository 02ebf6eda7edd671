"""Streams: the same functions for batches and for Structured Streaming."""

from .monitors import anomalies, windowed_counts

__all__ = ["anomalies", "windowed_counts"]
