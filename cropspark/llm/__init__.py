"""Operators of a training-data pipeline over text tables, and their registered queries.

Nothing else in the library imports this package.
"""
