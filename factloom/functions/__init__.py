"""Column functions: text, numbers, units, vectors, table cells."""
