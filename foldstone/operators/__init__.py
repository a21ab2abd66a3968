"""Folds of mutation logs into state, and everything that reads or moves that state."""
