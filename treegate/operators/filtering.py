"""Filter and validate frames, batch or streaming, by a grammar."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate import syntax
from treegate.errors import GrammarError
from treegate.functions.stdlib import Library
from treegate.functions.udfs import FunctionLibrary
from treegate.grammar import Grammar as Compiled
from treegate.labels import Tree
from treegate.plans import necessary, planner


class Grammar:
    """A parsed and checked grammar.

    ``filter(df)`` keeps the rows that it accepts, ``validate(df, name)`` adds a boolean
    column, ``column(df)`` is the condition itself.  By default a row's columns are the
    record; with ``on`` and ``format`` ("json", "xml", "protobuf" or one that was registered) a
    column's payload is.  All three are narrow and stateless, so they work on streams too.
    """

    def __init__(self, compiled: Compiled):
        self.compiled = compiled

    def plan(self, df: DataFrame, on: str | None = None, format: str | None = None, how: str | None = None, **options: Any) -> planner.Plan:
        if (on is None) != (format is None):
            raise GrammarError("on and format go together")
        if on is not None:
            return planner.plan_payload(self.compiled, on, format, **options)
        return planner.plan_rows(self.compiled, df, how)

    def column(self, df: DataFrame, on: str | None = None, format: str | None = None, **options: Any) -> Column:
        """True where a record is accepted; false or null elsewhere."""
        return self.plan(df, on, format, **options).column

    def filter(self, df: DataFrame, on: str | None = None, format: str | None = None, **options: Any) -> DataFrame:
        """The accepted rows, unchanged; broken payloads are dropped unless ``on_error="raise"``.

        JSON texts that can't be accepted for want of a name or string don't reach Python.
        """
        condition = self.column(df, on, format, **options)
        if format == "json" and options.get("on_error", "null") == "null" and isinstance(df.select(on).schema[0].dataType, T.StringType):
            guard = necessary.json_guard(self.compiled, F.col(on))
            condition = condition if guard is None else guard & condition
        return df.filter(condition)

    def validate(self, df: DataFrame, name: str = "valid", on: str | None = None, format: str | None = None, **options: Any) -> DataFrame:
        """``df`` with a boolean column; null only where a payload is null or broken."""
        plan = self.plan(df, on, format, **options)
        return df.withColumn(name, plan.column if on is not None else F.coalesce(plan.column, F.lit(False)))

    def explain(self, df: DataFrame, on: str | None = None, format: str | None = None, **options: Any) -> str:
        """How the grammar runs over the frame, and its condition."""
        plan = self.plan(df, on, format, **options)
        python = "" if plan.how == planner.PREDICATE else f" (rows go through Python: {plan.why})"
        return f"{self}\n{plan.how}{python}: {plan.column}"

    def accepts(self, forest: list[Tree]) -> bool:
        """Whether one record, given as a forest, is accepted; runs on the driver."""
        from treegate.automaton import Automaton

        return Automaton(self.compiled).accepts(forest)

    def __str__(self) -> str:
        return str(self.compiled)


def parse(text: str, functions: FunctionLibrary | None = None) -> Grammar:
    """Parses and checks a grammar, with user functions beside the standard library; raises :class:`GrammarError`."""
    return Grammar(Compiled(syntax.parse(text, Library(functions.table if functions else None))))


def filter(df: DataFrame, grammar: Grammar | str, **how: Any) -> DataFrame:  # noqa: A001
    """``grammar.filter(df)``; a text is parsed first."""
    return (parse(grammar) if isinstance(grammar, str) else grammar).filter(df, **how)


def validate(df: DataFrame, grammar: Grammar | str, name: str = "valid", **how: Any) -> DataFrame:
    """``grammar.validate(df, name)``; a text is parsed first."""
    return (parse(grammar) if isinstance(grammar, str) else grammar).validate(df, name, **how)
