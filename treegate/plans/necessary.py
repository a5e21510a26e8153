"""What a JSON text must hold to be accepted: tests that Spark makes before any text reaches Python.

A field name or string that every accepted record has stands in its text as it is, unless
some letter is written as an escape.  So a text without it, and without ``\\u``, is not
accepted, whatever else it says.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treegate.functions.expr import Call, Const, Expr, Var
from treegate.grammar import Grammar
from treegate.labels import STRING
from treegate.patterns import Pattern

#: Strings tested for, at most: the longest say most.
MOST = 6

#: What no JSON escape but ``\\u`` can write.
_PLAIN = re.compile(r"[0-9A-Za-z_ .:;,+-]+")


def _in_label(e: Expr) -> frozenset[str]:
    """The strings within every string label for which the expression holds."""
    if isinstance(e, Call) and e.function.name in ("eq", "hasPrefix", "hasSuffix", "contains") and len(e.args) == 2:
        a, b = e.args
        if isinstance(a, Var) and a.kind == STRING and isinstance(b, Const) and b.kind == STRING and _PLAIN.fullmatch(b.value):
            return frozenset([b.value])
    if isinstance(e, Call) and e.function.name in ("and", "or") and e.kind == "bool":
        a, b = map(_in_label, e.args)
        return a | b if e.function.name == "and" else a & b
    return frozenset()


def strings(g: Grammar) -> list[str]:
    """Strings that the text of every accepted record holds, the longest first."""

    def of(p: Pattern, open_names: frozenset[str]) -> frozenset[str]:
        match p.op:
            case "node":
                return _in_label(p.expr) | of(p.parts[0], open_names)
            case "ref":
                return frozenset() if p.name in open_names else of(g.productions[p.name], open_names | {p.name})
            case "contains":
                return of(p.parts[0], open_names)
            case "and" | "concat" | "interleave":
                return frozenset().union(*(of(q, open_names) for q in p.parts))
            case "or":
                first, *rest = (of(q, open_names) for q in p.parts)
                return first.intersection(*rest)
        return frozenset()

    return sorted(of(g.main, frozenset()), key=lambda s: (-len(s), s))[:MOST]


def json_guard(g: Grammar, payload: Column) -> Column | None:
    """False or null only for texts that aren't accepted; None if nothing is known."""
    found = strings(g)
    if not found:
        return None
    escaped = payload.contains("\\u")
    out = payload.contains(found[0]) | escaped
    for s in found[1:]:
        out = out & (payload.contains(s) | escaped)
    return out
