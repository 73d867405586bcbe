"""Operators of a training-data pipeline: tokenising, packing, formatting, filtering and de-duplication.

Nothing else in the library imports this subpackage.
"""
