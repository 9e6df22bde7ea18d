"""Column functions on texts and arrays."""
