"""Readers and writers: JSON lines, Python-literal lines, Parquet; test-table bindings."""
