"""Spark jobs that turn a bibliographic snapshot into a map of researchers."""
