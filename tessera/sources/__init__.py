"""Readers: Parquet tables of the index, git repositories, gold and query files."""
