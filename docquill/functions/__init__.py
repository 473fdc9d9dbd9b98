"""Function extensions and regular expressions of queries."""
