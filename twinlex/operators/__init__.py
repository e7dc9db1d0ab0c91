"""Relational operators: leak exclusion, dedup, splits, statistics, sampling, batches, vocabularies, translation metrics."""
