"""Grammars over raw payloads and whole rows: the automaton behind an Arrow UDF.

A worker keeps one automaton per grammar, so transitions learned from one batch serve
the next.  A payload that cannot be decoded gives null, or raises where asked for.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate import naive
from treegate.automaton import automaton
from treegate.errors import GrammarError
from treegate.grammar import Grammar
from treegate.labels import Tree
from treegate.sources import jsontree, proto, rows, xmltree

#: A format's decoder, made from the options of a call: the function from a payload to its forest, and what that raises.
Decoder = tuple[Callable[[Any], list[Tree]], type[Exception]]


def _protobuf(options: dict[str, Any]) -> Decoder:
    d = proto.Descriptors.from_bytes(options["descriptors"])
    message = d.message(options["message"])
    return (lambda data: proto.decode(d, message, data)), proto.ProtoError


_FORMATS: dict[str, Callable[[dict[str, Any]], Decoder]] = {
    "json": lambda options: (jsontree.decode, jsontree.JsonError),
    "xml": lambda options: (xmltree.decode, xmltree.XmlError),
    "protobuf": _protobuf,
}


def register_format(name: str, decode: Callable[..., list[Tree]], broken: type[Exception] = ValueError) -> None:
    """A payload format of one's own: ``decode(payload, **options)`` gives the forest, or raises ``broken``.

    A forest is a list of trees (label, children), a label a pair of kind and value; see
    :mod:`treegate.labels`. The function is shipped to executors with each grammar.
    """
    if name in ("json", "xml", "protobuf"):
        raise GrammarError(f"{name} is there already")
    _FORMATS[name] = lambda options: ((lambda payload: decode(payload, **options)) if options else decode, broken)


def _format(fmt: str) -> Callable[[dict[str, Any]], Decoder]:
    if fmt not in _FORMATS:
        raise GrammarError(f"unknown format {fmt}: one of {', '.join(_FORMATS)}")
    return _FORMATS[fmt]


#: How a worker judges a forest. The first is what plans use; the others are the definition, for comparison.
ENGINES: dict[str, Callable[[Grammar, str], Callable[[list[Tree]], bool]]] = {
    "automaton": lambda g, key: automaton(g, key).accepts,
    "derivative": lambda g, key: lambda forest: naive.accepts(g, forest),
    "shared derivative": lambda g, key: lambda forest: naive.accepts(g, forest, shared=True),
}


def _shipped(grammar: Grammar) -> tuple[bytes, str]:
    from pyspark import cloudpickle

    return cloudpickle.dumps(grammar), grammar.key()


#: Grammars that this worker has unpickled, by key.
_grammars: dict[str, Grammar] = {}


def _grammar(data: bytes, key: str) -> Grammar:
    if key not in _grammars:
        if len(_grammars) >= 64:
            _grammars.clear()
        _grammars[key] = pickle.loads(data)
    return _grammars[key]


def payload_column(grammar: Grammar, column: Column, fmt: str, on_error: str = "null", engine: str = "automaton", **options: Any) -> Column:
    """Whether the payload is accepted; null for null payloads and, unless ``on_error`` is "raise", for broken ones."""
    if on_error not in ("null", "raise"):
        raise GrammarError('on_error: "null" or "raise"')
    made = _format(fmt)
    made(options)  # raises here what it would raise on an executor
    data, key = _shipped(grammar)

    @F.arrow_udf(T.BooleanType())
    def accepts(payload: pa.Array) -> pa.Array:
        judge = ENGINES[engine](_grammar(data, key), key)
        decode, broken = made(options)
        out = []
        for x in payload.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                out.append(judge(decode(x)))
            except broken:
                if on_error == "raise":
                    raise
                out.append(None)
        return pa.array(out, pa.bool_())

    return accepts(column)


def row_column(grammar: Grammar, schema: T.StructType, engine: str = "automaton") -> Column:
    """Whether a whole row is accepted, by an engine."""
    data, key = _shipped(grammar)
    build_schema = schema.json()

    @F.arrow_udf(T.BooleanType())
    def accepts(row: pa.Array) -> pa.Array:
        judge = ENGINES[engine](_grammar(data, key), key)
        build = rows.forest_builder(T.StructType.fromJson(json.loads(build_schema)))
        return pa.array([judge(build(x)) for x in row.to_pylist()], pa.bool_())

    return accepts(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
