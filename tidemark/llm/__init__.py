"""Operators that prepare training data; the rest of the library does not import this subpackage."""
