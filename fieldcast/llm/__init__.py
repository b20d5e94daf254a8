"""Training-data operators: dedup, extraction, WARC, licences, quality, packing, tokens."""
