"""Operators for training-data corpora: tokens, personal data, page text, quality, toxicity, neighbours, mixing, duplicates."""
