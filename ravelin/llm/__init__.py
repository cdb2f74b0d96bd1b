"""Operators for building training corpora.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL; each other module holds one operator.
"""
