"""Column functions: text, geometry, JSON."""
