"""Operators for training-data pipelines over whole documents, pages and vectors."""
