"""Operators for training data: scoring, filtering, matching, mixing and formatting of texts."""
