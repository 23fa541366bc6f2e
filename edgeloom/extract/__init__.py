"""Extraction of relations from source text, by language."""
