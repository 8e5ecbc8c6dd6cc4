"""Training-data operators: packing, deduplication, classification, search, mixing and extraction.

Nothing else in the library imports this subpackage.
"""
