"""Training-data operators: quality, toxicity, near-duplicates, personal data, packing and more.

Nothing else in the library imports this subpackage.
"""
