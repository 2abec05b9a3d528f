"""Whole reports, from tables to result."""
