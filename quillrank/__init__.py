"""Curation of large collections of web items as Spark jobs."""
