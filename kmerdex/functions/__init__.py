"""Column functions on words over the DNA alphabet."""
