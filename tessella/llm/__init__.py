"""Operators for preparing training data: ten corpus-scale operators and their registered queries.

Nothing outside this package imports it.
"""
