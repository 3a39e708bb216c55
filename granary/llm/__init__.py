"""Training-data operators: mixing, language-model scoring, vector search, web archives, near-duplicate
joins, sharding, token files, byte-pair encoding, quality ledgers and pseudonyms."""
