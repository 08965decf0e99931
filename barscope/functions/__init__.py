"""Column functions: null-safe values, trailing windows, recursive averages, rule scopes."""
