"""Driver-facing queries: bindings of the test tables, queries and their oracle SQL."""
