"""The standard library: every function's typed forms, on values and on Spark columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from treegate.errors import GrammarError
from treegate.functions import regex
from treegate.functions.expr import FALSE, RAISE, TRUE, Call, Const, Expr, Overload, Var, call
from treegate.labels import BOOL, BYTES, DOUBLE, INT, KINDS, LISTS, STRING, UINT


#: No double is above it but NaN, which Spark orders last and IEEE comparisons leave out; a bound like this reaches scans.
_LAST = float("inf")


def _compared(kind: str, compare, greater: int | None):
    """A comparison; operand number ``greater`` must not be NaN for it to hold (None: neither, if both are columns)."""

    def column(a: Any, b: Any) -> Column:
        out = compare(_column(a), _column(b))
        if kind != DOUBLE:
            return out
        if greater is not None:
            guarded = [(a, b)[greater]]
        else:
            guarded = [a] if isinstance(a, Column) and isinstance(b, Column) else []
        for x in guarded:
            if isinstance(x, Column):
                out = out & (x <= F.lit(_LAST))
        return out

    return column


def _differ(kind: str):
    def column(a: Any, b: Any) -> Column:
        out = _column(a) != _column(b)
        return out | F.isnan(a) if kind == DOUBLE and isinstance(a, Column) and isinstance(b, Column) else out

    return column


def _column(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _elem(items: Any, at: Any) -> Any:
    if not 0 <= at < len(items):
        raise IndexError("index out of range")
    return items[at]


def _regex_column(pattern: Any, subject: Any) -> Column:
    if isinstance(pattern, Column):
        raise GrammarError("a pattern that depends on the label has no column form")
    return _column(subject).rlike("(?d)" + regex.translate(pattern)) if isinstance(subject, Column) else F.lit(regex.matches(pattern, subject))


def _strict(symbol):
    return lambda a, b: symbol(_column(a), _column(b))


def _table() -> dict[str, list[Overload]]:
    out: dict[str, list[Overload]] = {}

    def add(name: str, args: tuple[str, ...], returns: str, python, column=None, on_error: str = RAISE) -> None:
        out.setdefault(name, []).append(Overload(name, args, returns, python, column, on_error))

    for k in KINDS:
        add("eq", (k, k), BOOL, lambda a, b: a == b, _compared(k, lambda a, b: a == b, None), FALSE)
        add("ne", (k, k), BOOL, lambda a, b: a != b, _differ(k), FALSE)
        add("type", (k,), BOOL, lambda a: True, lambda a: _column(a).isNotNull(), FALSE)
    for k in (INT, UINT, DOUBLE, BYTES):
        add("ge", (k, k), BOOL, lambda a, b: a >= b, _compared(k, lambda a, b: a >= b, 0), FALSE)
        add("gt", (k, k), BOOL, lambda a, b: a > b, _compared(k, lambda a, b: a > b, 0), FALSE)
        add("le", (k, k), BOOL, lambda a, b: a <= b, _compared(k, lambda a, b: a <= b, 1), FALSE)
        add("lt", (k, k), BOOL, lambda a, b: a < b, _compared(k, lambda a, b: a < b, 1), FALSE)
    add("contains", (STRING, STRING), BOOL, lambda a, b: b in a, lambda a, b: _column(a).contains(_column(b)))
    for k in (STRING, INT, UINT):
        add("contains", (k, LISTS[k]), BOOL, lambda a, b: a in b, lambda a, b: _column(a).isin(*b) if isinstance(b, (list, tuple)) and not any(isinstance(x, Column) for x in b) else F.array_contains(_array(b), _column(a)))
    for k in KINDS:
        add("elem", (LISTS[k], INT), k, _elem, None)
        add("length", (LISTS[k],), INT, len, lambda a: F.lit(len(a)).cast("long"))
    add("length", (STRING,), INT, len, lambda a: F.char_length(_column(a)).cast("long"))
    add("length", (BYTES,), INT, len, lambda a: F.octet_length(_column(a)).cast("long"))
    add("not", (BOOL,), BOOL, lambda a: not a, lambda a: ~_column(a), TRUE)
    add("and", (BOOL, BOOL), BOOL, lambda a, b: a and b, _strict(lambda a, b: a & b))
    add("or", (BOOL, BOOL), BOOL, lambda a, b: a or b, _strict(lambda a, b: a | b))
    add("hasPrefix", (STRING, STRING), BOOL, lambda a, b: a.startswith(b), lambda a, b: _column(a).startswith(_column(b)))
    add("hasSuffix", (STRING, STRING), BOOL, lambda a, b: a.endswith(b), lambda a, b: _column(a).endswith(_column(b)))
    add("regex", (STRING, STRING), BOOL, regex.matches, _regex_column)
    add("toLower", (STRING,), STRING, str.lower, lambda a: F.lower(_column(a)))
    add("toUpper", (STRING,), STRING, str.upper, lambda a: F.upper(_column(a)))
    return out


def _array(items: Any) -> Column:
    return F.array(*[_column(x) for x in items])


TABLE = _table()

#: The infix builtins and their functions.
BUILTINS = {"==": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "~=": "regex", "*=": "contains", "^=": "hasPrefix", "$=": "hasSuffix", "::": "type"}


def resolve(table: dict[str, list[Overload]], name: str, args: list[Expr]) -> Expr:
    """The call of the form that takes these kinds."""
    forms = table.get(name)
    if forms is None:
        raise GrammarError(f"unknown function: {name}")
    kinds = tuple(x.kind for x in args)
    for form in forms:
        if form.args == kinds:
            if name == "regex" and isinstance(args[0], Const):
                regex.translate(args[0].value)
            return call(form, args)
    raise GrammarError(f"{name} doesn't take ({', '.join(kinds)})")


class Library:
    """The standard library, then user functions: what the former can't resolve goes to the latter."""

    def __init__(self, user: dict[str, list[Overload]] | None = None):
        self.user = user or {}

    def call(self, name: str, args: list[Expr]) -> Expr:
        try:
            return resolve(TABLE, name, args)
        except GrammarError as first:
            if name not in self.user:
                raise
            try:
                return resolve(self.user, name, args)
            except GrammarError as second:
                raise GrammarError(f"{first}; {second}") from second

    def builtin(self, symbol: str, operand: Expr) -> Expr:
        """``symbol operand``: the variable is of the operand's kind; regex takes the pattern first, type alone its operand."""
        name = BUILTINS[symbol]
        if name == "type":
            return self.call(name, [operand])
        kind = operand.kind
        if kind.startswith("[]") and kind[2:] in KINDS:
            if name != "contains":
                raise GrammarError(f"{symbol} doesn't take a list")
            kind = kind[2:]
        variable = Var(kind)
        return self.call(name, [operand, variable] if name == "regex" else [variable, operand])


def negation(e: Expr) -> Expr:
    return resolve(TABLE, "not", [e])


def either(a: Expr, b: Expr) -> Expr:
    return resolve(TABLE, "or", [a, b])


def equal(value: Expr) -> Expr:
    return resolve(TABLE, "eq", [Var(value.kind), value])


def negated_comparison(e: Expr) -> Expr | None:
    """The comparison that is true exactly where a comparison with an operand of the label's kind is false; None if there is none."""
    if isinstance(e, Call) and e.function.name in ("eq", "ne") and e.function.on_error == FALSE:
        return resolve(TABLE, "ne" if e.function.name == "eq" else "eq", list(e.args))
    return None
