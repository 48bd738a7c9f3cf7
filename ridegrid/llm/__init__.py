"""Training-data operators for text corpora (dedup, formatting, sharding, tokens, quality, ...)."""
