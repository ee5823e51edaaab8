"""Structured Streaming wrappers around the merge operators."""
