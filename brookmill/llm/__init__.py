"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered
queries and ``oracles.py`` the SQL they are compared with, where SQL can express them.
"""
