"""Operators for training-data pipelines over text, pages and embeddings."""
