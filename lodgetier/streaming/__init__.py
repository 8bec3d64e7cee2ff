"""The batch transforms over arriving files."""
