"""Structured Streaming ingest of the mirrored customer objects."""
