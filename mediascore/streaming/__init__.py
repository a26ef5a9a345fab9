"""Structured Streaming: continuous scoring and model refresh between
micro-batches."""

from mediascore.streaming.score_stream import ModelRefresher, VersionLog, start_envelope_stream, start_refreshing_stream, start_scoring_stream  # noqa: F401
