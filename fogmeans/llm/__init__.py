"""Training-data operators: scoring, filtering, dedup, mixing, tokenising, archives."""
