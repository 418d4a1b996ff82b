"""Reading and writing series."""
