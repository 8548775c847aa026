"""Training-data operators: similarity joins, search, deduplication, mixing, packing, classifiers, extraction, archives."""
