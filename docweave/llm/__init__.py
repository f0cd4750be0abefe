"""Training-data operators: deduplication, quality, language, decontamination, secrets, shards and packing."""
