"""Training-data operators: quality, toxicity, duplicates, contamination, mixing, archives and language-model scores."""
