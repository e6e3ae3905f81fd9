"""Operators for preparing training data: deduplication, archives, mixing, filtering and packing.

Nothing else in the library imports this subpackage.
"""
