"""Column helpers and fixed values."""
