"""Operators that prepare very large text corpora for model training.

Nothing outside this subpackage imports it.
"""
