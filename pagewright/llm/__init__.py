"""Training-data operators: deduplication, classification, scanning, search, tokenising and packing."""
