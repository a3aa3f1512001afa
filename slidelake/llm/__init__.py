"""Operators for building training corpora: mixing, language, extraction, deduplication, search and output."""
