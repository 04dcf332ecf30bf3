"""Operators for preparing language-model training data at scale.

Each module holds one operator with its own general interface; ``queries`` holds
the thin registered queries and their SQL.  Nothing outside this folder imports it.
"""
