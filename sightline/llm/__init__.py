"""Operators that prepare text corpora: token counts, deduplication, scoring, sharding, packing, search."""
