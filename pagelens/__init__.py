"""Audit of web documents, as PySpark DataFrame jobs."""
