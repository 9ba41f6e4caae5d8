"""Operators for preparing text for language-model training.

Nothing outside this subpackage imports it.  Every operator is a function from DataFrames to a
DataFrame; ``queries.py`` holds the thin registered queries.
"""
