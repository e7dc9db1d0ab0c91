"""Readers of aligned texts: every one gives rows (line_no, en, am, score)."""
