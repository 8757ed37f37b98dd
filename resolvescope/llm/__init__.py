"""Operators for training-data corpora: extraction, archives, mixing, counting, search, filters, de-duplication."""
