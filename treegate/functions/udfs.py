"""User functions: a registry of typed forms, each on values and, optionally, on Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import functions as F

from treegate.errors import GrammarError
from treegate.functions.expr import Overload
from treegate.labels import BOOL, INT, KINDS, LISTS, STRING, UINT

_TYPES = {*KINDS, *LISTS.values()}


class FunctionLibrary:
    """``library.register("inc", ["int"], "int", lambda x: x + 1, column=lambda c: c + 1)``.

    Functions see values, not records: a grammar binds the label with a variable. One
    without ``column`` works everywhere, but a typed frame is then filtered by the Arrow
    automaton instead of plain predicates.
    """

    def __init__(self) -> None:
        self.table: dict[str, list[Overload]] = {}

    def register(self, name: str, args: Iterable[str], returns: str, python: Callable, column: Callable | None = None) -> FunctionLibrary:
        args = tuple(args)
        for kind in (*args, returns):
            if kind not in _TYPES:
                raise GrammarError(f"{name}: unknown type {kind}")
        if any(x.args == args for x in self.table.get(name, [])):
            raise GrammarError(f"{name}({', '.join(args)}) is there already")
        self.table.setdefault(name, []).append(Overload(name, args, returns, python, column))
        return self


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _is_prime(c):
    n = c.cast("long")
    divisors = F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.sqrt(n)).cast("long")))
    return (n > 1) & ((n < 4) | F.forall(divisors, lambda d: n % d != 0))


def sample_library() -> FunctionLibrary:
    """inc(int), concat(string, string) and isPrime(int or uint)."""
    out = FunctionLibrary()
    out.register("inc", [INT], INT, lambda x: x + 1, column=lambda c: c + F.lit(1).cast("long"))
    out.register("concat", [STRING, STRING], STRING, lambda a, b: a + b, column=lambda a, b: F.concat(a if not isinstance(a, str) else F.lit(a), b if not isinstance(b, str) else F.lit(b)))
    for kind in (INT, UINT):
        out.register("isPrime", [kind], BOOL, is_prime, column=_is_prime)
    return out
