"""Operators that are folds over an ordered log."""
