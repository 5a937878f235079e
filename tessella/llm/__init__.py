"""Training-data operators: tokens, packing, quality, language, search and deduplication."""
