"""Operators over documents and free text for training-data pipelines."""
