"""Streaming ingest into a version store."""
