"""Training-data operators: quality, toxicity, near and exact dedup, token counts,
sharding, exact search, decontamination, subword encoding and page extraction.

Nothing else in the library imports this subpackage.
"""
