"""The operators bound to the test tables: roles, queries and their SQL twins."""
