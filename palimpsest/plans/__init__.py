"""Derived tables over the test data and the catalogue of queries with their SQL."""
