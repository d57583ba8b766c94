"""Column functions on text, JSON, vectors, identifiers; all built-in expressions."""
