"""Landed files and tables in, parquet and CSV out."""
