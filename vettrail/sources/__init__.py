"""Readers that turn recorded searches, key documents, pages and span tables into DataFrames."""
