"""Column functions: text, numbers, metrics."""
