"""Composite queries and the catalogue of named queries with the SQL each agrees with."""
