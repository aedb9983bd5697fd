"""Training-data operators: dedup, decontamination, classification, encoding, archives and sharding."""
