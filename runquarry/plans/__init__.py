"""Registered queries: each operator over the test tables, next to the SQL that states the same result."""
