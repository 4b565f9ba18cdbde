"""Column functions: text, paths and variables."""
