"""Catalogue matching analytics and corpus preparation, expressed in PySpark."""
