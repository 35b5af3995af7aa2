"""Operators of a training-data pipeline (documents, pages, conversations,
embeddings).  Nothing outside this folder imports it."""
