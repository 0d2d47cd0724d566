"""Operators for training-data pipelines: documents and vectors in, decisions out."""
