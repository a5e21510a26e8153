"""JSON text to forests.

Objects give a node per pair in document order, repeated keys kept; arrays a node per
element, labelled by its index; null gives no tree.  A number is an int if its exact
value is a whole number (``1.0`` and ``1e2`` are), else a double.
"""

from __future__ import annotations

import json
from fractions import Fraction
from typing import Any

from treegate.labels import BOOL, DOUBLE, INT, STRING, Tree, leaf, wrap_int

#: Exponents past this are decided without writing the number out.
_LARGE = 400


class _Pairs(list):
    """An object's pairs, told apart from an array."""


class _Number(str):
    """A number's text with a point or an exponent."""


class JsonError(ValueError):
    """Text that isn't one JSON value."""


def _constant(text: str) -> Any:
    raise JsonError(f"{text} isn't JSON")


_decoder = json.JSONDecoder(object_pairs_hook=_Pairs, parse_float=_Number, parse_constant=_constant)


def _number(text: str) -> Tree:
    mantissa, _, exponent = text.lower().partition("e")
    power = int(exponent or 0)
    if abs(power) > _LARGE:
        digits = mantissa.lstrip("-").replace(".", "").strip("0")
        if not digits:
            return leaf(INT, 0)
        if power > 0 and power >= len(mantissa):
            sign = -1 if mantissa.startswith("-") else 1
            whole = int(mantissa.lstrip("-").replace(".", ""))
            shift = power - len(mantissa.partition(".")[2])
            return leaf(INT, wrap_int(sign * whole * pow(10, shift, 2**64)))
        if power < 0 and -power >= len(mantissa):
            return leaf(DOUBLE, float(text))
    value = Fraction(text)
    return leaf(INT, wrap_int(value.numerator)) if value.denominator == 1 else leaf(DOUBLE, float(text))


def _forest(value: Any) -> list[Tree]:
    """Iterative, so depth is bounded by the decoder alone."""
    out: list[Tree] = []
    todo: list[tuple[Any, list[Tree]]] = [(value, out)]
    while todo:
        value, into = todo.pop()
        if value is None:
            continue
        if isinstance(value, bool):
            into.append(leaf(BOOL, value))
        elif isinstance(value, int):
            into.append(leaf(INT, wrap_int(value)))
        elif isinstance(value, _Number):
            into.append(_number(value))
        elif isinstance(value, str):
            into.append(leaf(STRING, value))
        else:
            pairs = [((STRING, k), v) for k, v in value] if isinstance(value, _Pairs) else [((INT, i), v) for i, v in enumerate(value)]
            for label, v in pairs:
                children: list[Tree] = []
                into.append((label, children))
                todo.append((v, children))
    return out


def decode(text: str) -> list[Tree]:
    """The forest of one JSON value; raises :class:`JsonError`."""
    try:
        return _forest(_decoder.decode(text))
    except JsonError:
        raise
    except (ValueError, OverflowError) as e:  # the library raises a ValueError of its own
        raise JsonError(str(e)) from e
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> list[Tree]:
    """The same for text nested too deeply for the library: scalars by the library, brackets by a stack."""
    out: list[Tree] = []
    stack: list[tuple[str, list[Tree], int]] = []  # (kind, children, next index)
    kind, into, index = "value", out, 0
    i, n, expect = 0, len(text), "value"
    key: str | None = None
    blank = " \t\n\r"

    def slot() -> list[Tree]:
        nonlocal index, key
        if kind == "value":
            return into
        children: list[Tree] = []
        into.append((((STRING, key) if kind == "{" else (INT, index)), children))
        index, key = index + 1, None
        return children

    while True:
        while i < n and text[i] in blank:
            i += 1
        c = text[i : i + 1]
        if expect == "end":
            if c:
                raise JsonError(f"at {i}: end expected")
            return out
        if not c:
            raise JsonError("text ends inside a value")
        if expect in ("key", "key or }"):
            if c == "}" and expect == "key or }":
                expect = "close"
                continue
            if c != '"':
                raise JsonError(f"at {i}: a key expected")
            key, i = _decoder.raw_decode(text, i)
            while i < n and text[i] in blank:
                i += 1
            if text[i : i + 1] != ":":
                raise JsonError(f"at {i}: ':' expected")
            i, expect = i + 1, "value"
            continue
        if expect == "close" or (expect == "value or ]" and c == "]") or (expect == "next" and c in "]}"):
            if c != {"{": "}", "[": "]"}.get(kind):
                raise JsonError(f"at {i}: {c!r} unexpected")
            kind, into, index = stack.pop()
            i, expect = i + 1, "next" if stack or kind != "value" else "end"
            continue
        if expect == "next":
            if c != ",":
                raise JsonError(f"at {i}: ',' expected")
            i, expect = i + 1, "key" if kind == "{" else "value"
            continue
        children = slot()
        if c in "{[":
            stack.append((kind, into, index))
            kind, into, index = c, children, 0
            i, expect = i + 1, "key or }" if c == "{" else "value or ]"
            continue
        try:
            value, i = _decoder.raw_decode(text, i)
        except ValueError as e:
            raise JsonError(str(e)) from e
        children.extend(_forest(value))
        expect = "end" if kind == "value" else "next"
