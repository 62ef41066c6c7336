"""Operators for building training corpora: dedup, decontamination, scoring, tokens, archives."""
