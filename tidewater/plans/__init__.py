"""Adapters onto the given tables, registered queries and their SQL."""
