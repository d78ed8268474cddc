"""Column functions and column-adding transforms."""
