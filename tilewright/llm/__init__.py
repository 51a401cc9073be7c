"""Operators for large training corpora: each module holds one operator and the query that applies it."""
