"""The same state kinds live, on transformWithState."""
