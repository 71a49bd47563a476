"""Structured Streaming jobs: file ingest, run events, run status, running totals."""
