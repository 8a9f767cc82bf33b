"""Readers and writers: packages, relationships, text, cells, PDF bytes."""
