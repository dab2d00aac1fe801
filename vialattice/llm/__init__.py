"""Operators that prepare large text corpora for training.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
