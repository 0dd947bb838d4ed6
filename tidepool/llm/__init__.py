"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage.
"""
