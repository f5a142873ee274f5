"""The operators over the given tables: views, queries and their SQL."""
