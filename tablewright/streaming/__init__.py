"""Structured Streaming: sources, windowed metrics, stream joins, learners."""
