"""Training-data operators: mixing, search, classifiers, dedup, sharding, packing, token counts and token files."""
