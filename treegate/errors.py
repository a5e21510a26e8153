"""Errors of grammars and records."""


class GrammarError(ValueError):
    """A grammar that cannot be parsed, typed or compiled."""


class RecordError(Exception):
    """A label that an expression cannot read; the whole record is then not accepted."""
