"""Typed scalar expressions, evaluated on the label of one node.

Every expression has a kind: one of the six of :mod:`treegate.labels`, or a list of one
(``[]int``).  Evaluation gives a value or raises :class:`RecordError` where a variable
meets a label of another kind; functions pass that on, except comparisons and ``type``
(false) and ``not`` (true).  Expressions without variables are folded when built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from treegate.errors import GrammarError, RecordError
from treegate.labels import BOOL, BYTES, DOUBLE, KINDS, STRING, Label

#: What a function makes of an operand that cannot be read.
RAISE, FALSE, TRUE = "raise", "false", "true"


@dataclass(frozen=True)
class Expr:
    """Base of expressions; equality is structural."""

    kind: str

    def eval(self, label: Label) -> Any:
        raise NotImplementedError

    @property
    def has_variable(self) -> bool:
        raise NotImplementedError


@dataclass(frozen=True)
class Const(Expr):
    value: Any

    def eval(self, label: Label) -> Any:
        return self.value

    @property
    def has_variable(self) -> bool:
        return False

    def __str__(self) -> str:
        return literal(self.kind, self.value)


@dataclass(frozen=True)
class Var(Expr):
    def eval(self, label: Label) -> Any:
        if label[0] != self.kind:
            raise RecordError(f"not a {self.kind}")
        return label[1]

    @property
    def has_variable(self) -> bool:
        return True

    def __str__(self) -> str:
        return "$[]byte" if self.kind == BYTES else f"${self.kind}"


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]

    def eval(self, label: Label) -> Any:
        return [x.eval(label) for x in self.items]

    @property
    def has_variable(self) -> bool:
        return any(x.has_variable for x in self.items)

    def __str__(self) -> str:
        return f"{type_name(self.kind)}{{{','.join(map(str, self.items))}}}"


@dataclass(frozen=True)
class Overload:
    """One typed form of a function: ``python`` on values, ``column`` on Spark columns (or None)."""

    name: str
    args: tuple[str, ...]
    returns: str
    python: Callable[..., Any] = field(compare=False)
    column: Callable[..., Any] | None = field(compare=False, default=None)
    on_error: str = field(compare=False, default=RAISE)


@dataclass(frozen=True)
class Call(Expr):
    function: Overload
    args: tuple[Expr, ...]

    def eval(self, label: Label) -> Any:
        if self.function.on_error == RAISE:
            return self.function.python(*[x.eval(label) for x in self.args])
        try:
            values = [x.eval(label) for x in self.args]
        except RecordError:
            return self.function.on_error == TRUE
        return self.function.python(*values)

    @property
    def has_variable(self) -> bool:
        return any(x.has_variable for x in self.args)

    def __str__(self) -> str:
        return f"{self.function.name}({','.join(map(str, self.args))})"


def call(function: Overload, args: list[Expr]) -> Expr:
    """A call, folded if it has no variable, with the identities of ``not``, ``and`` and ``or``."""
    out = Call(function.returns, function, tuple(args))
    if not out.has_variable:
        try:
            return Const(out.kind, out.eval((BOOL, True)))
        except RecordError:
            return out
        except (IndexError, ValueError, ArithmeticError, TypeError) as e:
            raise GrammarError(f"{out}: {e}") from e
    name = function.name
    if name in ("and", "or") and out.kind == BOOL:
        a, b = args
        unit, zero = (True, False) if name == "and" else (False, True)
        for x, y in ((a, b), (b, a)):
            if isinstance(x, Const):
                # the absorbing constant still reads the other side, which may not be readable
                return y if x.value is unit else (x if x.value is zero and never_fails(y) else out)
        if a == b:
            return a
    if name == "not" and isinstance(args[0], Call) and args[0].function.name == "not" and never_fails(args[0].args[0]):
        return args[0].args[0]
    return out


def never_fails(e: Expr) -> bool:
    """Whether the expression gives a value on labels of every kind."""
    if isinstance(e, Const):
        return True
    if isinstance(e, Var):
        return False
    if isinstance(e, ListOf):
        return all(map(never_fails, e.items))
    assert isinstance(e, Call)
    return e.function.on_error != RAISE or (e.function.name in ("and", "or") and all(map(never_fails, e.args)))


def list_of(kind: str, items: list[Expr]) -> Expr:
    for x in items:
        if x.kind != kind:
            raise GrammarError(f"a list of {kind} holds {x}")
    out = ListOf(f"[]{kind}", tuple(items))
    return out if out.has_variable else Const(out.kind, tuple(x.eval((BOOL, True)) for x in items))


def type_name(kind: str) -> str:
    return kind.replace("bytes", "[]byte")


def literal(kind: str, value: Any) -> str:
    """Grammar text of a constant; it parses to the same constant."""
    if kind.startswith("[]") and kind[2:] in KINDS:
        return f"{type_name(kind)}{{{','.join(literal(kind[2:], x) for x in value)}}}"
    if kind == BOOL:
        return "true" if value else "false"
    if kind == STRING:
        return '"' + "".join(_escaped(c) for c in value) + '"'
    if kind == BYTES:
        return "[]byte{" + ",".join(str(b) for b in value) + "}"
    if kind == DOUBLE:
        return f"double({repr(value).replace('e', 'E')})"
    return f"{kind}({value})" if kind == "uint" else str(value)


def _escaped(c: str) -> str:
    if c in '"\\':
        return "\\" + c
    if c.isprintable():
        return c
    return f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}"
