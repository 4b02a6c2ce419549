"""Structured Streaming over source folders."""
