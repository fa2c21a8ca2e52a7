"""Training-data operators: formatting, mixing, scanning, filtering, tokenising and deduplication."""
