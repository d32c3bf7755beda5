"""Annotation analytics and data processing on PySpark."""
