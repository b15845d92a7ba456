"""Training-data operators: sharding, search, tokenization, quality, mixing, scoring and deduplication."""
