"""Structured Streaming operators for task queues, stage state and token streams."""
