"""Training-data operators: dedup, decontamination, filters, mixing, sharding and token output."""
