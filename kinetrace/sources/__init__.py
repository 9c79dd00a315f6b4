"""Readers, writers and the generator of test data."""
