"""Structured Streaming jobs that share the batch expressions."""
