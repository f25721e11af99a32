"""Training-data operators: dedup, filtering, mixing, tokenizing, search."""
