"""Operators for preparing training data: packing, mixing, deduplication, scans, scoring, search."""
