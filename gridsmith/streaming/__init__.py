"""Structured Streaming forms of operators that add up."""
