"""Training-data operators: dedup, joins, mixing, packing, sharding, counting, language and fixity."""
