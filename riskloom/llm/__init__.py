"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only if it can be imported.
"""
