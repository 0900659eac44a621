"""Operators for training-data pipelines: truncation, vector search, near-duplicates, residue, page
furniture, tokenisation, packing and moderation. Nothing else in the library imports this subpackage."""
