"""Operators for the preparation of training corpora."""
