"""Training-data operators: mixing, packing, near-duplicates, quality, toxicity, language, shards."""
