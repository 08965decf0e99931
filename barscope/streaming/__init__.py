"""Daily increments as a stream of files."""
