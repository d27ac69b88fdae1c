"""Operators of a training-data pipeline over the ``documents`` family of tables.

Nothing outside this subpackage imports it.  ``queries`` registers one thin
query per operator.
"""
