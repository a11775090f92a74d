"""Training-data operators: deduplication, filtering, scoring, encoding, packing and sharding of text corpora."""
