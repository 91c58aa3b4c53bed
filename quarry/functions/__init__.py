"""Column expressions of the query language: globs, names, text windows, result texts."""
