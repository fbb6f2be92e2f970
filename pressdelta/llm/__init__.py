"""Operators for preparing language-model training data at scale.

Self-contained: nothing else in the library imports this subpackage.
"""
