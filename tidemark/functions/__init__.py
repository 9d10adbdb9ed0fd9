"""Column expressions for text, numbers, dates and semantic types."""
