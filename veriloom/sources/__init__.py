"""Reading, combining and writing tables."""
