"""Structured Streaming over arriving shards and training logs."""
