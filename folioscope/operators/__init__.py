"""Relational operators over the corpus tables."""
