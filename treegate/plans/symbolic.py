"""Grammars over typed frames as plain predicates.

The names of a frame's columns and struct fields are known, so a grammar is derived over
the schema once, with conditions in place of truths: which residual patterns are left
after each field, and on which conditions over its value.  A scalar gives comparisons
on its column.  An array or map gives a finite automaton over its elements, which is
emitted as ``exists``, ``forall`` or an element access where it has that shape, else as
an ``aggregate`` over state numbers.  Labels that cannot be read reject the row, as in
the automaton; as types are known, where that happens is known too.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from decimal import Decimal
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treegate import patterns as P
from treegate import steps
from treegate.errors import GrammarError, RecordError
from treegate.functions.expr import RAISE, TRUE, Call, Const, Expr, ListOf, Var
from treegate.functions.stdlib import TABLE, negated_comparison
from treegate.grammar import Grammar
from treegate.labels import BOOL, INT, STRING, UINT
from treegate.patterns import Pattern
from treegate.plans import bdd
from treegate.plans.bdd import Atom, Diagrams
from treegate.sources.rows import check_map, scalar_kind

#: Residual patterns of a level, conditions on a label that may fail and states of an element automaton, at most.
PATTERNS, CONDITIONS, STATES = 1_000, 8, 24


class NoPlan(Exception):
    """The grammar has no predicate of bounded size over this schema."""


class Unreadable(Exception):
    """An expression over a label of this kind always fails."""


def lower_expr(e: Expr, kind: str, value: Any) -> Any:
    """A column, or a Python value if it doesn't depend on the label; raises :class:`Unreadable`."""
    if isinstance(e, Const):
        return _python(e.kind, e.value)
    if isinstance(e, Var):
        if e.kind != kind:
            raise Unreadable
        return value
    if isinstance(e, ListOf):
        return [lower_expr(x, kind, value) for x in e.items]
    assert isinstance(e, Call)
    f = e.function
    try:
        args = [lower_expr(x, kind, value) for x in e.args]
    except Unreadable:
        if f.on_error == RAISE:
            raise
        return f.on_error == TRUE
    if not any(_has_column(a) for a in args):
        return _python(f.returns, f.python(*[_plain(a) for a in args]))
    if f.column is None:
        raise NoPlan(f"{f.name} has no column form")
    if f.returns == BOOL and f.name in ("and", "or", "not"):
        args = [F.lit(a) if isinstance(a, bool) else a for a in args]
    try:
        return f.column(*args)
    except GrammarError as err:
        raise NoPlan(str(err)) from err


def _has_column(x: Any) -> bool:
    return isinstance(x, Column) or (isinstance(x, (list, tuple)) and any(map(_has_column, x)))


def _python(kind: str, value: Any) -> Any:
    if kind == UINT:
        return Decimal(value)
    return [_python(kind[2:], v) for v in value] if kind.startswith("[]") else value


def _plain(x: Any) -> Any:
    if isinstance(x, Decimal):
        return int(x)
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def _has_user_function(e: Expr) -> bool:
    if isinstance(e, Call):
        return e.function not in TABLE.get(e.function.name, []) or any(map(_has_user_function, e.args))
    return isinstance(e, ListOf) and any(map(_has_user_function, e.items))


def _unreadable(e: Expr, kind: str) -> bool:
    """Whether the expression fails on every label of this kind."""
    if isinstance(e, Var):
        return e.kind != kind
    if isinstance(e, ListOf):
        return any(_unreadable(x, kind) for x in e.items)
    return isinstance(e, Call) and e.function.on_error == RAISE and any(_unreadable(x, kind) for x in e.args)


def _member(e: Expr, path: tuple, column: Column) -> tuple[tuple, Column, Any] | None:
    """(column's path, column, value) of an equality with a constant that ``isin`` can take over."""
    if isinstance(e, Call) and e.function.name == "eq" and isinstance(e.args[0], Var) and isinstance(e.args[1], Const):
        value = e.args[1].value
        if e.args[0].kind == STRING or (e.args[0].kind == INT and -(2**31) <= value < 2**31):
            return path, column, value
    return None


class Lowering:
    """One grammar over one schema.

    Where no label can be unreadable (``readable``: what every node of the grammar may
    meet is known from the types), what is left of a pattern only counts by what it
    accepts: alternatives, conjunctions and complements are lowered part by part and
    joined as diagrams, and nodes that no later field can be are dropped at once.
    Elsewhere a label that is read or not decides, so the pattern is derived as a whole.
    """

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.readable = False

    def record(self, schema: T.StructType, column: Callable[[str], Column], main: Pattern | None = None) -> tuple[Diagrams, int]:
        """The diagram of acceptance of a row by ``main`` (else the grammar's); ``column`` gives a top-level column."""
        main = main or self.grammar.main
        self.readable = not self._may_fail(main, schema, {})
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))  # diagrams are as deep as they have conditions
        d = Diagrams()
        fields = [(f.name, f.dataType, column(f.name), (f.name,)) for f in schema.fields]
        accepted, failed = self._fields(d, fields, [main])
        return d, d.both(accepted[0], d.negate(failed))

    def _may_fail(self, p: Pattern, kind: T.DataType, known: dict) -> bool:
        """Whether a label in a forest of this type may be unreadable to some node of the pattern or of a residual."""
        key = (p, kind)
        if key not in known:
            known[key] = False  # a repeat on the way down adds nothing
            nodes = steps.level(self.grammar, p)
            if isinstance(kind, T.StructType):
                known[key] = any(self._may_fail_at(n, (STRING, f.name), f.dataType, known) for f in kind.fields for n in nodes)
            elif isinstance(kind, (T.ArrayType, T.MapType)):
                item, label = (kind.valueType, STRING) if isinstance(kind, T.MapType) else (kind.elementType, INT)
                known[key] = any(_unreadable(n.expr, label) or self._may_fail(n.parts[0], item, known) for n in nodes)
            else:
                name = scalar_kind(kind)
                known[key] = name is not None and any(_unreadable(n.expr, name) for n in nodes)
        return known[key]

    def _may_fail_at(self, n: Pattern, label: tuple[str, str], kind: T.DataType, known: dict) -> bool:
        try:
            return bool(n.expr.eval(label)) and self._may_fail(n.parts[0], kind, known)
        except RecordError:
            return True

    def _decided(self, d: Diagrams, p: Pattern, whole: Callable[[Pattern], int]) -> int:
        """Acceptance of a forest by the parts of a pattern, as far as it is a combination of some; else by ``whole``."""
        if self.readable:
            match p.op:
                case "any":
                    return bdd.TRUE
                case "or":
                    return d.any([self._decided(d, q, whole) for q in p.parts])
                case "and":
                    return d.all([self._decided(d, q, whole) for q in p.parts])
                case "not":
                    return d.negate(self._decided(d, p.parts[0], whole))
                case "ref":
                    return self._decided(d, self.grammar.productions[p.name], whole)
        return whole(p)

    def _moves(self, d: Diagrams, p: Pattern, took: Callable[[Pattern], int]) -> dict[Pattern, int]:
        """The patterns that may follow one tree, each with the diagram of when; ``took``: when a node takes the tree."""

        def each(moves: dict[Pattern, int], change: Callable[[Pattern], Pattern]) -> dict[Pattern, int]:
            out: dict[Pattern, int] = {}
            for q, how in moves.items():
                r = change(q)
                out[r] = d.either(out[r], how) if r in out else how
            return out

        def cross(ways: list[dict[Pattern, int]], join: Callable[[list[Pattern]], Pattern]) -> dict[Pattern, int]:
            total = ways[0]
            for more in ways[1:]:
                out: dict[Pattern, int] = {}
                for q, x in total.items():
                    for r, y in more.items():
                        how = d.both(x, y)
                        if how != bdd.FALSE:
                            both = join([q, r])
                            out[both] = d.either(out[both], how) if both in out else how
                total = out
                if len(total) > PATTERNS:
                    raise NoPlan("too many residual patterns")
            return total

        match p.op:
            case "empty":
                return {P.NONE: bdd.TRUE}
            case "any":
                return {P.ANY: bdd.TRUE}
            case "node":
                how = took(p)
                return {q: x for q, x in ((P.EMPTY, how), (P.NONE, d.negate(how))) if x != bdd.FALSE}
            case "ref":
                return self._moves(d, self.grammar.productions[p.name], took)
            case "not":
                return each(self._moves(d, p.parts[0], took), P.negate)
            case "optional":
                return self._moves(d, p.parts[0], took)
            case "star":
                return each(self._moves(d, p.parts[0], took), lambda q: P.concat(q, p))
            case "contains":
                return each(self._moves(d, p.parts[0], took), lambda q: P.union([p, P.contains(q)]))
            case "or":
                return cross([self._moves(d, q, took) for q in p.parts], P.union)
            case "and":
                return cross([self._moves(d, q, took) for q in p.parts], P.intersection)
            case "concat":
                head = each(self._moves(d, p.parts[0], took), lambda q: P.concat(q, p.parts[1]))
                return cross([head, self._moves(d, p.parts[1], took)], P.union) if p.parts[0].nullable else head
        ways = []
        for i, part in enumerate(p.parts):
            rest = [*p.parts[:i], *p.parts[i + 1 :]]
            ways.append(each(self._moves(d, part, took), lambda q, rest=rest: P.interleave([q, *rest])))
        return cross(ways, P.union)

    # forests of fields: known names, in order

    def _fields(self, d: Diagrams, fields: list[tuple[str, T.DataType, Column, tuple]], ps: list[Pattern]) -> tuple[list[int], int]:
        """For each pattern the diagram of its acceptance of the fields, and that of failure."""
        names = tuple(f[0] for f in fields)
        if len(set(names)) != len(names):
            raise GrammarError("two columns have one name: rename one")
        failed = bdd.FALSE

        def whole(p: Pattern) -> int:
            nonlocal failed
            accepted, wrong = self._in_order(d, fields, names, p)
            failed = d.either(failed, wrong)
            return accepted

        return [self._decided(d, p, whole) for p in ps], failed

    def _in_order(self, d: Diagrams, fields: list[tuple[str, T.DataType, Column, tuple]], names: tuple[str, ...], p: Pattern) -> tuple[int, int]:
        """Acceptance of the fields by one pattern, and failure: the residuals that each field may leave, then their diagrams from the last field back.

        Conditions get their places in the diagram on the way forth, so on the way back every field adds on top.
        """
        last: dict[Expr, int] = {}

        def alive(e: Expr, i: int) -> bool:
            """Whether some field from the i-th on has a name for which the expression holds."""
            if e not in last:
                last[e] = next((j for j in range(len(names) - 1, -1, -1) if e.eval((STRING, names[j]))), -1)
            return last[e] >= i

        start = self._pruned(p, lambda e: alive(e, 0))
        states: dict[Pattern, None] = {start: None}
        ways: list[dict[Pattern, tuple[dict[Pattern, int], int] | None]] = []
        for i, (name, kind, column, path) in enumerate(fields):
            ways.append({})
            for q in states:
                if P.is_settled(q):
                    ways[i][q] = {q: bdd.TRUE}, bdd.FALSE
                    continue
                try:
                    taken = [n for n in steps.asked(self.grammar, q) if n.expr.eval((STRING, name))]
                except RecordError:
                    ways[i][q] = None
                    continue
                inside = list(dict.fromkeys(n.parts[0] for n in taken))
                bits, wrong = self._value(d, kind, column, path, inside)
                accepted = dict(zip(inside, bits, strict=True))
                when = {n: accepted[n.parts[0]] for n in taken}
                after: dict[Pattern, int] = {}
                for r, how in self._moves(d, q, lambda n: when.get(n, bdd.FALSE)).items():
                    r = self._pruned(r, lambda e: alive(e, i + 1))
                    after[r] = d.either(after.get(r, bdd.FALSE), how)
                ways[i][q] = after, wrong
            states = {r: None for way in ways[i].values() if way is not None for r in way[0]}
            if len(states) > PATTERNS:
                raise NoPlan("too many residual patterns")
        accepts = {q: bdd.TRUE if q.nullable else bdd.FALSE for q in states}
        fails = dict.fromkeys(states, bdd.FALSE)
        for table in reversed(ways):
            now: dict[Pattern, tuple[int, int]] = {}
            for q, way in table.items():
                if way is None:
                    now[q] = bdd.FALSE, bdd.TRUE
                else:
                    after, wrong = way
                    now[q] = d.any([d.both(how, accepts[r]) for r, how in after.items()]), d.any([wrong, *(d.both(how, fails[r]) for r, how in after.items())])
            accepts, fails = {q: x for q, (x, _) in now.items()}, {q: x for q, (_, x) in now.items()}
        return accepts[start], fails[start]

    def _pruned(self, p: Pattern, alive: Callable[[Expr], bool]) -> Pattern:
        """A pattern that accepts the same forests of the fields to come, without the nodes that are none of them."""
        if not self.readable:
            return p
        prune = lambda q: self._pruned(q, alive)
        match p.op:
            case "node":
                return p if alive(p.expr) else P.NONE
            case "concat":
                return P.concat(*map(prune, p.parts))
            case "interleave":
                return P.interleave(list(map(prune, p.parts)))
            case "or":
                return P.union(list(map(prune, p.parts)))
            case "and":
                return P.intersection(list(map(prune, p.parts)))
            case "not":
                return P.negate(prune(p.parts[0]))
            case "contains":
                return P.contains(prune(p.parts[0]))
            case "star" | "optional":
                inner = prune(p.parts[0])
                return P.EMPTY if inner is P.NONE else (P.star if p.op == "star" else P.optional)(inner)
        return p

    # the forest of one value

    def _value(self, d: Diagrams, kind: T.DataType, column: Column, path: tuple, ps: list[Pattern]) -> tuple[list[int], int]:
        """For each pattern the diagram of its acceptance of a column's forest, and that of failure."""
        if all(P.is_settled(p) for p in ps):
            return [bdd.TRUE if p is P.ANY else bdd.FALSE for p in ps], bdd.FALSE
        absent = d.atom(Atom((path, "null"), column.isNull, column.isNotNull))
        empty = [bdd.TRUE if p.nullable else bdd.FALSE for p in ps]
        if isinstance(kind, T.StructType):
            fields = [(f.name, f.dataType, column.getField(f.name), (*path, f.name)) for f in kind.fields]
            accepted, failed = self._fields(d, fields, ps)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            accepted, failed = self._elements(d, kind, column, path, ps)
        else:
            accepted, failed = self._leaf(d, kind, column, path, ps)
        present = d.negate(absent)
        out = []
        for a, e in zip(accepted, empty, strict=True):
            # a predicate on a null column isn't true, so the null test is only needed where that differs
            out.append(a if a not in (bdd.TRUE, bdd.FALSE) and self._when_absent(d, a, path) == e else d.ite(absent, e, a))
        return out, failed if failed == bdd.FALSE or self._when_absent(d, failed, path) == bdd.FALSE else d.both(present, failed)

    def _when_absent(self, d: Diagrams, f: int, path: tuple) -> int:
        """The diagram with every condition on this column false; -1 if others decide."""
        while f > bdd.TRUE:
            level, low, _ = d.nodes[f]
            if d.atoms[level].implies_present != path:
                return -1
            f = low
        return f

    def _leaf(self, d: Diagrams, kind: T.DataType, column: Column, path: tuple, ps: list[Pattern]) -> tuple[list[int], int]:
        nodes = {p: steps.asked(self.grammar, p) for p in ps}
        name = scalar_kind(kind)
        if name is None and any(nodes.values()):
            raise GrammarError(f"column {'.'.join(map(str, path))} is {kind.simpleString()}, which has no label: cast it")
        truths: dict[Expr, int] = {}
        failed = bdd.FALSE
        for e in dict.fromkeys(n.expr for ns in nodes.values() for n in ns):
            try:
                truths[e] = self._condition(d, e, name, column, path)
            except Unreadable:
                failed = bdd.TRUE
        if failed:
            return [bdd.FALSE] * len(ps), failed

        def whole(p: Pattern) -> int:
            moves = self._moves(d, p, lambda n: truths[n.expr] if n.parts[0].nullable else bdd.FALSE)
            return d.any([how for q, how in moves.items() if q.nullable])

        return [self._decided(d, p, whole) for p in ps], failed

    def _condition(self, d: Diagrams, e: Expr, kind: str, column: Column, path: tuple) -> int:
        """The diagram of an expression over a label; logic in it becomes logic of the diagram."""
        if isinstance(e, Call) and e.kind == BOOL and e.function.name in ("and", "or"):
            parts = [self._condition(d, x, kind, column, path) for x in e.args]
            return (d.both if e.function.name == "and" else d.either)(*parts)
        if isinstance(e, Call) and e.kind == BOOL and e.function.name == "not":
            try:
                return d.negate(self._condition(d, e.args[0], kind, column, path))
            except Unreadable:
                return bdd.TRUE
        lowered = lower_expr(e, kind, column)
        if isinstance(lowered, bool):
            return bdd.TRUE if lowered else bdd.FALSE
        if _has_user_function(e):
            lowered = lowered & column.isNotNull()  # its column may be true on null
        opposite = negated_comparison(e)

        def negated() -> Column:
            if opposite is not None:
                other = lower_expr(opposite, kind, column)
                return (other if isinstance(other, Column) else F.lit(other)) | column.isNull()
            return ~F.coalesce(lowered, F.lit(False))

        return d.atom(Atom((path, kind, e), lambda: lowered, negated, path, _member(e, path, column)))

    # forests of elements: unknown number, labels by index or key

    def _elements(self, d: Diagrams, kind: T.ArrayType | T.MapType, column: Column, path: tuple, ps: list[Pattern]) -> tuple[list[int], int]:
        if isinstance(kind, T.MapType):
            check_map(kind)
        failed = bdd.FALSE

        def whole(p: Pattern) -> int:
            nonlocal failed
            if P.is_settled(p):
                return bdd.TRUE if p is P.ANY else bdd.FALSE
            machine = Elements(self, kind, p)
            accept = machine.column(column, lambda s: s >= 0 and machine.states[s].nullable)
            if machine.fails:
                wrong = machine.column(column, lambda s: s < 0)
                failed = d.either(failed, d.atom(Atom((path, "failed", p), lambda: wrong, lambda: ~F.coalesce(wrong, F.lit(False)), path)))
            return d.atom(Atom((path, "elements", p), lambda: accept, lambda: ~F.coalesce(accept, F.lit(False)), path))

        return [self._decided(d, p, whole) for p in ps], failed


class Elements:
    """The finite automaton of a pattern over an array's or map's elements; state -1 is failure."""

    def __init__(self, lowering: Lowering, kind: T.ArrayType | T.MapType, start: Pattern):
        self.lowering, self.kind = lowering, kind
        self.is_map = isinstance(kind, T.MapType)
        self.item = kind.valueType if self.is_map else kind.elementType
        self.states: list[Pattern] = [start]
        self.moves: list[list[tuple[Callable[[Diagrams, Column, Column], int], int]]] = []
        self.fails = False
        # the shape is found with placeholder columns; conditions are rebuilt inside lambdas
        d = Diagrams()
        self.tables: list[dict[int, int]] = []
        probe_at, probe_item = F.col("__at"), F.col("__item")
        i = 0
        while i < len(self.states):
            table: dict[int, int] = {}
            for q, how in self._next(d, self.states[i], probe_at, probe_item).items():
                if q is None:
                    number, self.fails = -1, True
                elif q in self.states:
                    number = self.states.index(q)
                else:
                    number = len(self.states)
                    self.states.append(q)
                table[number] = how
            self.tables.append(table)
            i += 1
            if len(self.states) > STATES:
                raise NoPlan("too many states over the elements")

    def _next(self, d: Diagrams, p: Pattern, at: Column, item: Column) -> dict[Pattern | None, int]:
        """Followers of a state (None: failure) with diagrams over the label and the element."""
        if P.is_settled(p):
            return {p: bdd.TRUE}
        low = self.lowering
        nodes = steps.asked(low.grammar, p)
        label_kind = STRING if self.is_map else INT
        truths: dict[Expr, int] = {}
        for e in dict.fromkeys(n.expr for n in nodes):
            try:
                truths[e] = low._condition(d, e, label_kind, at, ("__label",))
            except Unreadable:
                return {None: bdd.TRUE}
        children = list(dict.fromkeys(n.parts[0] for n in nodes))
        if low.readable:
            accepted = dict(zip(children, low._value(d, self.item, item, ("__item",), children)[0], strict=True))
            return low._moves(d, p, lambda n: d.both(truths[n.expr], accepted[n.parts[0]]))
        if len(truths) > CONDITIONS:
            raise NoPlan("too many conditions on one element")
        out: dict[Pattern | None, int] = {}
        # which label conditions hold decides which children are asked, and so what may fail
        for chosen in product((False, True), repeat=len(truths)):
            known = dict(zip(truths, chosen, strict=True))
            how = bdd.TRUE
            for e, t in known.items():
                how = d.both(how, truths[e] if t else d.negate(truths[e]))
            if how == bdd.FALSE:
                continue
            asked = [c for c in children if any(n.parts[0] is c and known[n.expr] for n in nodes)]
            bits, failed = low._value(d, self.item, item, ("__item",), asked) if asked else ([], bdd.FALSE)
            accepted = dict(zip(asked, bits, strict=True))
            if failed != bdd.FALSE:
                out[None] = d.either(out.get(None, bdd.FALSE), d.both(how, failed))
            fine = d.both(how, d.negate(failed))
            for q, then in low._moves(d, p, lambda n: accepted[n.parts[0]] if known[n.expr] else bdd.FALSE).items():
                both = d.both(fine, then)
                if both != bdd.FALSE:
                    out[q] = d.either(out.get(q, bdd.FALSE), both)
        return out

    def _conditions(self, state: int, at: Column, item: Column) -> list[tuple[int, Column]]:
        """(next state, condition) of a state over actual columns; the last holds otherwise."""
        d = Diagrams()
        table = self._next(d, self.states[state], at, item)
        rows = [(-1 if q is None else self.states.index(q), how) for q, how in table.items()]
        # to stay is what happens otherwise, else the first
        rows.sort(key=lambda r: r[0] == state)
        return [(n, F.coalesce(d.column(how), F.lit(False))) for n, how in rows]

    def _rows(self, column: Column) -> Column:
        return F.map_entries(column) if self.is_map else column

    def column(self, column: Column, wanted: Callable[[int], bool]) -> Column:
        """Whether the state after all elements is wanted; null for a null column."""
        ends = {s: wanted(s) for s in range(-1, len(self.states))}
        simple = self._simple(column, ends)
        if simple is not None:
            return simple
        # a fold over state numbers; -1 and settled states keep themselves
        entries = F.transform(self._rows(column), (lambda x: F.struct(x["key"].alias("at"), x["value"].alias("item"))) if self.is_map else (lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("item"))))

        def step(state: Column, x: Column) -> Column:
            out = None
            for s in range(len(self.states)):
                if P.is_settled(self.states[s]):
                    continue
                rows = self._conditions(s, x["at"], x["item"])
                then = F.lit(rows[-1][0])
                for n, how in reversed(rows[:-1]):
                    then = F.when(how, F.lit(n)).otherwise(then)
                out = F.when(state == s, then) if out is None else out.when(state == s, then)
            return out.otherwise(state) if out is not None else state

        good = [s for s, yes in ends.items() if yes]
        final = F.aggregate(entries, F.lit(0), step)
        return final.isin(*good) if good else F.lit(False) & column.isNotNull()

    def _simple(self, column: Column, ends: dict[int, bool]) -> Column | None:
        """exists, forall or an element access, if the automaton has two states and one of them is final."""
        settled = [P.is_settled(p) for p in self.states]
        if self.fails or len(self.states) != 2 or settled != [False, True] or ends[0] == ends[1]:
            return None
        go = self.tables[0].get(1)
        if go is None or set(self.tables[0]) != {0, 1}:
            return None

        def moves(x: Column, i: Column | None = None) -> Column:
            at, item = (x["key"], x["value"]) if self.is_map else (i if i is not None else F.lit(None).cast("long"), x)
            return next(c for n, c in self._conditions(0, at, item) if n == 1)

        index = None if self.is_map else self._index()
        if index is not None:
            # only one place is looked at
            there = moves(F.get(column, F.lit(index)), F.lit(index).cast("long"))
            hit = (F.size(column) > index) & there
            return hit if ends[1] else ~hit & column.isNotNull()
        rows = self._rows(column)
        if self.is_map or not self._needs_label():
            if ends[1]:
                return F.exists(rows, lambda x: moves(x))
            stays = lambda x: ~moves(x)
            return F.forall(rows, stays)
        pairs = F.transform(rows, lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("item")))
        return F.exists(pairs, lambda y: moves(y["item"], y["at"])) if ends[1] else F.forall(pairs, lambda y: ~moves(y["item"], y["at"]))

    def _names(self) -> list[Expr]:
        return list(dict.fromkeys(n.expr for n in steps.asked(self.lowering.grammar, self.states[0])))

    def _needs_label(self) -> bool:
        return any(not isinstance(e, Const) for e in self._names())

    def _index(self) -> int | None:
        """The one index that the start state asks for."""
        names = self._names()
        if len(names) == 1 and isinstance(names[0], Call) and names[0].function.name == "eq":
            a, b = names[0].args
            if isinstance(a, Var) and a.kind == INT and isinstance(b, Const) and 0 <= b.value < 2**31:
                return b.value
        return None
