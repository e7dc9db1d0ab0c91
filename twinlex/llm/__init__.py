"""Operators for large-scale training-data pipelines: dedup, decontamination, filtering, scoring, packing and binary output."""
