"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` lists its queries and their SQL.
"""
