"""Training-data operators: deduplication, tokenisation, packing, scoring, search and formatting."""
