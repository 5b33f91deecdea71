"""Readers: files, databases and generated tables."""
