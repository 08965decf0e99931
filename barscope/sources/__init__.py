"""Reading and writing of bar, rank and list tables."""
