"""Operators for preparing large text corpora for model training.

Nothing else in ``lectern`` imports this subpackage; it may be removed as a whole.
"""
