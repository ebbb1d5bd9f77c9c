"""Operators for preparing training data: formatting, dedup, tokenising, filtering, packing, scoring."""
