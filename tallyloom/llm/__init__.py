"""Training-data operators: dedup, PII, WARC, mixing, extraction, packing, fingerprints, quality, URL rules."""
