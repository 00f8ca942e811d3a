"""Structured Streaming: forward-only extraction."""
