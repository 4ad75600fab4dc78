"""Training-data operators: tokenising, language ID, deduplication, packing, sharding and storage."""
