"""Training-data operators: sharding, search, scoring, mixing, dedup, archives, packing, chat."""
