"""Training-data operators: quality, dedup, decontamination, mixing, sharding and output."""
