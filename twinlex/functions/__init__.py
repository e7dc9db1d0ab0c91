"""Column expressions: text normalization, pair filters, numbers."""
