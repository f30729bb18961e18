"""Micro-batch ingestion of a growing submission log (Structured Streaming)."""
