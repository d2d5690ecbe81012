"""Operators for training-data pipelines: one module per operator, its query beside it."""
