"""Test-table mappings and the registered queries with their SQL twins."""
