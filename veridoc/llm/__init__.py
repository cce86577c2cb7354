"""Training-data operators: dedup, filtering, token counting, packing and encoding of documents."""
