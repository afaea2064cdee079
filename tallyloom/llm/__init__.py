"""Training-data operators: scoring, classification, packing, deduplication, extraction, search, licences, archives."""
