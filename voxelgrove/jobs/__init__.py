"""Queries that apply the operators to the given tables, with their SQL."""
