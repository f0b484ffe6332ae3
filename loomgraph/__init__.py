"""Cypher over Spark tables: a declared mapping presents DataFrames as a property graph."""
