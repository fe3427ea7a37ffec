"""Registered queries, the inputs they derive and their check SQL."""
