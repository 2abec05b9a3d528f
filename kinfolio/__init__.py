"""Kinfolio: a PySpark engine that organises photo libraries by identity."""
