"""Operators: pure functions from DataFrames to DataFrames. Ranked lists are (query_id, list_id, edge_id, rank)."""
