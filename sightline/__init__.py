"""Catalog retrieval and corpus preparation as Spark DataFrame jobs."""
