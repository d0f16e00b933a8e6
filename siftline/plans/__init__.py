"""Registered queries: each binds operators to the given tables, with the SQL it is checked against."""
