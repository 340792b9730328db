"""Column functions over arrays of atoms."""
