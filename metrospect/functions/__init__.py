"""Column expressions: text, lexical metrics, vectors, run names."""
