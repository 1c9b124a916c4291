"""Structured Streaming over run logs."""
