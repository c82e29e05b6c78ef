"""Column functions: text, dates, amounts and nested values."""
