"""Column expressions: tokenisers, query signals, vector arithmetic."""
