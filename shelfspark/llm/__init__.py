"""Corpus operators for training data made of listing texts.

Nothing else in the library imports this subpackage.
"""
