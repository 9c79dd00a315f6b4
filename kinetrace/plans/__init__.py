"""Queries: operators bound to tables, with the SQL that gives the same rows."""
