"""Sources of the usage-analytics library."""
