"""The pipeline over streams."""
