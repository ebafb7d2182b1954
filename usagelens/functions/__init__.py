"""Column functions on host sets, GPU sets and scalars."""
