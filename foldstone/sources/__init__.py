"""Mutation logs from tables, and snapshot items on any Hadoop file system."""
