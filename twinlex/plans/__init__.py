"""Whole jobs: configuration, corpus build, vocabulary, batches, reports."""
