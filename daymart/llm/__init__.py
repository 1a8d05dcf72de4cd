"""Training-data operators: deduplication, filtering, encoding, mixing and sharding of document tables."""
