"""Structured Streaming ingest: landed pages -> normalised, merged store."""
