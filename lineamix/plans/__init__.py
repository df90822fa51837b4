"""Composed studies and the query catalog."""
