"""Relational operators that Spark has no single call for, composed of DataFrame operations."""
