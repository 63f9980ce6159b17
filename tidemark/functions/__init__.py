"""Column functions of the usage reports: names, numbers and dates."""
