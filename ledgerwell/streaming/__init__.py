"""Structured Streaming forms of the capture and movement paths."""
