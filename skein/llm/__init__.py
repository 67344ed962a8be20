"""Operators that prepare training data: dedup, scans, scoring, tokenising, packing."""
