"""Streaming forms of session features and scoring."""
