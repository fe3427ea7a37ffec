"""Readers and writers for corpora, records, vectors and result tables."""
