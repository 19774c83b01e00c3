"""Training-data operators: archives, deduplication, fingerprints, decontamination, quality, mixing, sharding, formatting.

Nothing outside this subpackage imports it.
"""
