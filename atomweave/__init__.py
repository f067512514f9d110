"""Atomweave: content-addressed atoms, vectors, lineage and usage analytics on Spark."""
