"""Training-data operators: sharding, cleaning, deduplication, search and tokenization of text corpora."""
