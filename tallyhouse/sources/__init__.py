"""Reading landed files and writing lake tables."""
