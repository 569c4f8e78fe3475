"""Readers, and the store of versioned tables."""
