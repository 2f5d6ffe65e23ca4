"""Operators for training-data pipelines: archives, privacy, tokens, near copies, mixing."""
