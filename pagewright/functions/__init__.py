"""Column functions: text, geometry, HTML and parameters."""
