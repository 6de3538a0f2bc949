"""Training-data operators: scoring, archives, de-duplication, extraction, packing, chat and quality."""
