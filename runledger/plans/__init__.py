"""Whole jobs built from the operators: ingest, read functions, test views, query catalog."""
