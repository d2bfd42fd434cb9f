"""Operators over DataFrames: chunking, search, ingest, listing, export."""
