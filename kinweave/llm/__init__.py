"""Training-data operators: scoring, filtering, de-duplication, encoding, packing, search and extraction.

Nothing else in the library imports this subpackage.
"""
