"""Readers, writers and views on the benchmark tables."""
