"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and their SQL.
"""
