"""Reading and writing listing tables."""
