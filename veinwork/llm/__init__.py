"""Operators that prepare text and records for language-model training."""
