"""Corpus-preparation operators for training data: extraction, deduplication, filtering, mixing and encoding.

Nothing else in the library imports this subpackage.
"""
