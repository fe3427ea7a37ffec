"""Structured Streaming twin of the batch curation job."""
