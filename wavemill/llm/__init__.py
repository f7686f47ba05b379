"""Operators for building training corpora. Nothing else in wavemill imports this package."""
