"""Ordered sends and their acknowledgements, from logs and from streams."""
