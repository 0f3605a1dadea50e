"""Training-data operators: filters, deduplication, packing and storage for text corpora.

Nothing else in the library imports this subpackage.
"""
