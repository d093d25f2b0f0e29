"""Training-data operators: quality, sharding, licences, near duplicates, lines, tokens, packing.

Nothing outside this subpackage imports it.
"""
