"""Structured Streaming over whole sequences."""
