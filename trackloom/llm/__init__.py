"""Operators for large text corpora: filtering, deduplication, extraction, formatting, mixing and packing.

Nothing else in the library imports this subpackage.
"""
