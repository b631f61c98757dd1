"""Training-data operators: tokenising, near-duplicates, scans, language, packing, sharding, quality.

Nothing else in the library imports this package; deleting it leaves the rest working.
"""
