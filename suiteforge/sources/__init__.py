"""Readers and writers: JSON lines, JSON arrays, parquet, round-partitioned layouts."""
