"""Column expressions over typed records."""
