"""Queries over the driver tables, each with the SQL it is checked against."""
