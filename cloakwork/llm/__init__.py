"""Operators for building training corpora: search, mixing, dedup, scans, tokenizing, scoring."""
