"""Chooses how a grammar runs over a frame: plain predicates where the schema allows, else the automaton."""

from __future__ import annotations

import copy
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate import patterns as P
from treegate.grammar import Grammar
from treegate.patterns import Pattern
from treegate.plans import arrow, bdd, symbolic

PREDICATE, AUTOMATON, MIXED = "predicate", "automaton", "predicate and automaton"


class PythonPlan(UserWarning):
    """Rows of a typed frame go through Python, where a predicate was hoped for."""


@dataclass
class Plan:
    """``column``: true where a row is accepted, else false or null; ``how``: predicate, automaton or both; ``why``: for the automaton."""

    column: Column
    how: str
    why: str = ""


def _has(t: T.DataType, *kinds: type) -> bool:
    if isinstance(t, kinds):
        return True
    if isinstance(t, T.StructType):
        return any(_has(f.dataType, *kinds) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _has(t.elementType, *kinds)
    return isinstance(t, T.MapType) and (_has(t.keyType, *kinds) or _has(t.valueType, *kinds))


def plan_rows(grammar: Grammar, df: DataFrame, how: str | None = None) -> Plan:
    """The plan over whole rows of a typed frame; ``how`` forces one.

    Of a conjunction, parts that have a predicate are predicates, which Spark evaluates
    and pushes down before the automaton sees a row; a plan that needs the automaton
    without being asked to warns of it.
    """
    schema = df.schema
    if how == AUTOMATON:
        return Plan(arrow.row_column(grammar, schema), AUTOMATON, "asked for")
    lowering = symbolic.Lowering(grammar)

    def predicate(main: Pattern | None = None) -> Column:
        diagrams, f = lowering.record(schema, lambda name: F.col(f"`{name}`"), main)
        return diagrams.column(f)

    try:
        return Plan(predicate(), PREDICATE)
    except (symbolic.NoPlan, bdd.TooLarge) as e:
        if how == PREDICATE:
            raise
        why = str(e) or "the conditions are too large"
    warnings.warn(f"every row that reaches this part of the grammar goes through Python: {why}", PythonPlan, stacklevel=3)
    main, conditions, rest = grammar.main, [], []
    if lowering.readable and main.op == "and" and not grammar.names_main():
        for p in main.parts:
            try:
                conditions.append(predicate(p))
            except (symbolic.NoPlan, bdd.TooLarge):
                rest.append(p)
    if not conditions:
        return Plan(arrow.row_column(grammar, schema), AUTOMATON, why)
    left = copy.copy(grammar)
    left.productions = grammar.productions | {"main": P.intersection(rest)}
    column = conditions[0]
    for c in [*conditions[1:], arrow.row_column(left, schema)]:
        column = column & c
    return Plan(column, MIXED, why)


def plan_payload(grammar: Grammar, column: str, fmt: str, on_error: str = "null", **options) -> Plan:
    """The plan over a column of raw payloads."""
    return Plan(arrow.payload_column(grammar, F.col(column), fmt, on_error, **options), AUTOMATON, f"{fmt} payloads have no schema")
