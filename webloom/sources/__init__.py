"""Readers and writers for captured pages, seeds, word lists and tables."""
