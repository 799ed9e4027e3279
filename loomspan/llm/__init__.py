"""Corpus preparation for training data: ten operators and their queries.

Nothing outside this package imports it.
"""
