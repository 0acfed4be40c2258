"""Training-data operators: deduplication, filtering, packing and sharding of text corpora.

Nothing outside this folder imports it; it can be removed without touching the rest.
"""
