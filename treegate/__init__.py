"""Validation and filtering of tree-shaped records by grammars, on Spark.

    from treegate import parse
    parse('.l_returnflag == "R"').filter(lineitem)
"""

from treegate.errors import GrammarError, RecordError
from treegate.functions.udfs import FunctionLibrary, sample_library
from treegate.operators.filtering import Grammar, filter, parse, validate  # noqa: A004
from treegate.plans.arrow import register_format
from treegate.plans.planner import PythonPlan

__all__ = ["FunctionLibrary", "Grammar", "GrammarError", "PythonPlan", "RecordError", "filter", "parse", "register_format", "sample_library", "validate"]
