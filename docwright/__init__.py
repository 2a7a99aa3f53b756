"""Batch document retrieval and analytics on PySpark."""
