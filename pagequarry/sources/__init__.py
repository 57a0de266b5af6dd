"""Readers of source files and the stored tables."""
