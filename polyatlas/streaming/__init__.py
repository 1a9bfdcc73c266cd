"""Structured Streaming ingest."""

from .fragments import stream_counts, stream_fragments

__all__ = ["stream_counts", "stream_fragments"]
