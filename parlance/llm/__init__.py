"""Training-data operators: dedup, filters, mixing, tokenizing, fingerprints over a documents table."""
