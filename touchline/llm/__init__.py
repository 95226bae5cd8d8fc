"""Training-data operators: extraction, tokens, language, deduplication, decontamination, archives."""
