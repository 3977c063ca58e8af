"""Operators for preparing text corpora: duplicates, packing, languages, quality, mixing and search."""
