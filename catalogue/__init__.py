"""Registered queries: fixture tables derived from the given tables, Spark queries and their SQL twins."""
