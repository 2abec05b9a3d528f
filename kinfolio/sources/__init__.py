"""Readers of libraries: databases, image files and their metadata."""
