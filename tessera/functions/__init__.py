"""Column functions: native expressions only."""
