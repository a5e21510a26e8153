"""Typed expressions over one label: the standard library, regular expressions and user functions."""
