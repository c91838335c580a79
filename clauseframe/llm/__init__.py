"""Operators for preparing training data: one module for each, with its query."""
