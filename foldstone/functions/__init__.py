"""Column expressions: key groups, order hashes, expiry."""
