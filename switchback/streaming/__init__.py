"""Structured Streaming: recorded track points as they arrive."""
