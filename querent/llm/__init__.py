"""Operators for building language-model training data, and their queries.

Nothing else in the library imports this package; the registered queries are in
``queries.py``.
"""
