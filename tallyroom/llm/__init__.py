"""Training-data operators: deduplication, filters, tokenizing, packing, search and extraction."""
