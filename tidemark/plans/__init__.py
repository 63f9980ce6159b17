"""Plans of the usage-analytics library."""
