"""Operators for large training-data corpora: packing, search, filters, tokenizing, archives and near-copies."""
