"""Operators for preparing large text corpora for model training.

Nothing else in the package imports this subpackage; it can be deleted without
touching the rest.
"""
