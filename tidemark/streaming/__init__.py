"""Streaming of the usage-analytics library."""
