"""Operators for large text corpora: counting, near-duplicates, scans, models, mixing and packing.

Nothing else in the library imports this subpackage. Each module holds one operator with a
general interface; ``queries`` derives the registered results from them.
"""
