"""Operators for building training data at scale: filters, deduplication, extraction, packing, output formats."""
