"""Training-data operators: search, classification, dedup, packing and mixing.

Nothing outside this subpackage imports it.
"""
