"""Operators for building training corpora: deduplication, filtering, formatting, mixing and encoding."""
