"""Column expressions over sorted neighbour arrays."""
