"""Operators that prepare text and vectors for training models.

Nothing outside this subpackage imports it.
"""
