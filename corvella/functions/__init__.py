"""Column expressions: text, vectors, principals."""
