"""Spark values to forests, by their types: what a typed frame means to a grammar.

A column is a node labelled by its name, in schema order; null gives no children.
Arrays give nodes labelled by index, maps by their string keys, structs nest.  Integer
types are int, float and double double, decimal(20,0) uint.  Other types have no label:
the field's node is there, but a leaf predicate on it is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from treegate.errors import GrammarError
from treegate.labels import BOOL, BYTES, DOUBLE, INT, STRING, UINT, Tree, leaf


def scalar_kind(t: T.DataType) -> str | None:
    """The label kind of a scalar type, None if it has none."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return DOUBLE
    if isinstance(t, T.DecimalType) and (t.precision, t.scale) == (20, 0):
        return UINT
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    return BYTES if isinstance(t, T.BinaryType) else None


def check_map(t: T.MapType) -> None:
    if scalar_kind(t.keyType) != STRING:
        raise GrammarError(f"map keys must be strings, not {t.keyType.simpleString()}")


def forest_builder(t: T.DataType) -> Callable[[Any], list[Tree]]:
    """A function from a value (as Arrow's to_pylist gives it) to its forest."""
    if isinstance(t, T.StructType):
        fields = [(f.name, forest_builder(f.dataType)) for f in t.fields]

        def struct(value: Any) -> list[Tree]:
            return [] if value is None else [((STRING, name), build(value[name])) for name, build in fields]

        return struct
    if isinstance(t, T.ArrayType):
        item = forest_builder(t.elementType)
        return lambda value: [] if value is None else [((INT, i), item(x)) for i, x in enumerate(value)]
    if isinstance(t, T.MapType):
        check_map(t)
        item = forest_builder(t.valueType)
        return lambda value: [] if value is None else [((STRING, k), item(x)) for k, x in (value.items() if isinstance(value, dict) else value)]
    kind = scalar_kind(t)
    if kind is None:
        name = t.simpleString()
        return lambda value: [] if value is None else [((f"<{name}>", value), [])]
    if kind in (UINT, INT):
        return lambda value: [] if value is None else [leaf(kind, int(value))]
    if kind == BYTES:
        return lambda value: [] if value is None else [leaf(kind, bytes(value))]
    return lambda value: [] if value is None else [leaf(kind, value)]
