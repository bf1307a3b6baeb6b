"""Snapshot analytics on Spark: versioned collections as relations, reconciled with DataFrame operations."""
