"""Operators of the usage-analytics library."""
