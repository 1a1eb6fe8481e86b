"""How long jobs are cut into stages."""
