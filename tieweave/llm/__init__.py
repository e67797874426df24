"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; ``queries`` holds the thin registered queries over them.
"""
