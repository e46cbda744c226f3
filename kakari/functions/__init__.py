"""Column functions on text, feature lists and patterns."""
