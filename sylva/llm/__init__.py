"""Operators for building training corpora: sharding, deduplication, scoring, filtering, mixing, packing, archives."""
