"""Column expressions: paths, package names, comments and import statements."""
