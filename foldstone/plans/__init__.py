"""State declarations and the registered queries with their SQL."""
