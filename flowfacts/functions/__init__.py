"""Column functions: versions, names, secrets, lattices."""
