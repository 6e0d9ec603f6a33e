"""Readers, import rules and sinks."""
