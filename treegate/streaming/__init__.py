"""Grammars on streams."""
