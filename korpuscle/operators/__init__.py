"""Operators over hits, tokens and documents."""
