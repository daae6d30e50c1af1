"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``queries`` holds the thin registered
queries and their SQL.
"""
