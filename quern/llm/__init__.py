"""Corpus operators for training data: duplicates, leaks, quality, language, tokens, search.

Nothing outside this subpackage imports it.
"""
