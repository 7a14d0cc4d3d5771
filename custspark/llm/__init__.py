"""Operators for preparing large text, vector and page collections.

Each module holds one operator with its own general interface;
``queries.py`` registers the thin queries over the given tables.
Nothing else in the library imports this subpackage.
"""
