"""What the types of records are."""
