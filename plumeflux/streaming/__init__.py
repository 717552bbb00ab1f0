"""Resumable and streaming ingest."""
