"""Structured Streaming: the batch operators over unbounded trades."""
