"""Reduced ordered decision diagrams over named atoms, and their Spark predicates.

Conditions met on the way through a schema are kept as diagrams, so what two ways
share, contradict or imply falls away before any column is built.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The diagram's leaves.
FALSE, TRUE = 0, 1
#: Equalities with one column that make a list, and conditions of an expression at most.
LISTED, TERMS = 3, 5_000


@dataclass(frozen=True)
class Atom:
    """A two-valued condition. ``build``: a column that is true where it holds (null or false elsewhere);
    ``negated``: one that is true exactly where it does not hold."""

    key: Any
    build: Callable[[], Column]
    negated: Callable[[], Column]
    implies_present: Any = None  # key of the null test that this atom excludes
    member: tuple[Any, Column, Any] | None = None  # (key, column, value) of an equality: several become one ``isin``


class TooLarge(Exception):
    """The diagram outgrew its bound."""


class Diagrams:
    """A manager of diagrams over atoms in order of first use; nodes are numbered, 0 and 1 are the leaves."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.atoms: list[Atom] = []
        self.level: dict[Any, int] = {}
        self.nodes: list[tuple[int, int, int]] = [(1 << 30, 0, 0), (1 << 30, 1, 1)]
        self.unique: dict[tuple[int, int, int], int] = {}
        self.cache: dict[tuple[int, int, int], int] = {}

    def atom(self, a: Atom) -> int:
        if a.key not in self.level:
            self.level[a.key] = len(self.atoms)
            self.atoms.append(a)
        return self._node(self.level[a.key], FALSE, TRUE)

    def _node(self, level: int, low: int, high: int) -> int:
        if low == high:
            return low
        key = (level, low, high)
        found = self.unique.get(key)
        if found is None:
            if len(self.nodes) > self.limit:
                raise TooLarge
            found = self.unique[key] = len(self.nodes)
            self.nodes.append(key)
        return found

    def ite(self, c: int, a: int, b: int) -> int:
        """a where c holds, else b."""
        if c == TRUE or a == b:
            return a
        if c == FALSE:
            return b
        if (a, b) == (TRUE, FALSE):
            return c
        key = (c, a, b)
        found = self.cache.get(key)
        if found is None:
            top = min(self.nodes[x][0] for x in key)
            low, high = ([self.nodes[x][side] if self.nodes[x][0] == top else x for x in key] for side in (1, 2))
            found = self.cache[key] = self._node(top, self.ite(*low), self.ite(*high))
        return found

    def both(self, a: int, b: int) -> int:
        return self.ite(a, b, FALSE)

    def either(self, a: int, b: int) -> int:
        return self.ite(a, TRUE, b)

    def negate(self, a: int) -> int:
        return self.ite(a, FALSE, TRUE)

    def any(self, fs: list[int]) -> int:
        """Whether one holds; the deepest first, so a list of new atoms costs a node each."""
        out = FALSE
        for f in sorted(fs, key=lambda f: -self.nodes[f][0]):
            out = self.either(f, out)
        return out

    def all(self, fs: list[int]) -> int:
        out = TRUE
        for f in sorted(fs, key=lambda f: -self.nodes[f][0]):
            out = self.both(f, out)
        return out

    def column(self, f: int) -> Column:
        """A column that is true where the diagram is; null or false elsewhere.

        Raises :class:`TooLarge` where the expression, which shares nothing, would have over ``TERMS`` conditions.
        """
        shapes: dict[int, _Shape] = {}
        sizes: dict[int, int] = {}

        def measure(x: int | _Shape) -> int:
            if isinstance(x, _Shape):
                return len(x.atoms) + sum(map(measure, x.parts))
            if x <= TRUE:
                return 1
            if x not in sizes:
                shapes[x] = self._shape(x)
                sizes[x] = measure(shapes[x])
            return sizes[x]

        if measure(f) > TERMS:
            raise TooLarge
        done: dict[int, Column] = {FALSE: F.lit(False), TRUE: F.lit(True)}

        def build(x: int | _Shape) -> Column:
            if isinstance(x, _Shape):
                return _joined(x.atoms, list(map(build, x.parts)), x.any_of)
            if x not in done:
                done[x] = build(shapes[x])
            return done[x]

        return build(f)

    def _shape(self, f: int) -> _Shape:
        """A node as alternatives or as a conjunction: a run of atoms, two diagrams with no atom in common, or by its own atom."""
        level, low, high = self.nodes[f]
        for end in (TRUE, FALSE):
            if end in (low, high):
                return self._run(f, end)
        for end in (TRUE, FALSE):
            found = self._bottleneck(f, end)
            if found is not None:
                return _Shape(end == FALSE, [], [self._replaced(f, found, end, {}), found])
        atom = self.atoms[level]
        return _Shape(True, [], [_Shape(False, [(atom, True)], [high]), _Shape(False, [(atom, False)], [low])])

    def _run(self, f: int, end: int) -> _Shape:
        """The atoms (and whether each must hold) that lead down from a node and each end at one leaf, and what is left."""
        atoms: list[tuple[Atom, bool]] = []
        while f > TRUE:
            level, low, high = self.nodes[f]
            if end not in (low, high):
                return _Shape(end == TRUE, atoms, [f])
            holds = high == end
            # alternatives end where an atom has its way, conjunctions where it hasn't
            atoms.append((self.atoms[level], holds == (end == TRUE)))
            f = low if holds else high
        return _Shape(end == TRUE, atoms, [])

    def _bottleneck(self, f: int, end: int) -> int | None:
        """The first node below ``f`` that all ways to the leaf ``end`` go through; None if there is none."""
        below, todo = {f}, [f]
        while todo:
            for x in self.nodes[todo.pop()][1:]:
                if x > TRUE and x not in below:
                    below.add(x)
                    todo.append(x)
        order = sorted(below, key=lambda x: self.nodes[x][0])
        ways = {end: 1, 1 - end: 0}
        for x in reversed(order):
            ways[x] = ways[self.nodes[x][1]] + ways[self.nodes[x][2]]
        reach = dict.fromkeys(order, 0) | {f: 1}
        for x in order:
            if x != f and reach[x] * ways[x] == ways[f]:
                return x
            for y in self.nodes[x][1:]:
                if y > TRUE:
                    reach[y] += reach[x]
        return None

    def _replaced(self, f: int, node: int, leaf: int, done: dict[int, int]) -> int:
        if f == node:
            return leaf
        if f <= TRUE:
            return f
        if f not in done:
            level, low, high = self.nodes[f]
            done[f] = self._node(level, self._replaced(low, node, leaf, done), self._replaced(high, node, leaf, done))
        return done[f]


@dataclass(frozen=True)
class _Shape:
    """Alternatives (``any_of``) or a conjunction of atoms, each of which holds or not, and of nodes or further shapes."""

    any_of: bool
    atoms: list[tuple[Atom, bool]]
    parts: list[Any]


def _joined(atoms: list[tuple[Atom, bool]], rest: list[Column], any_of: bool) -> Column:
    """One column of many, as a balanced tree; equalities of one column that all widen or all narrow it are one list."""
    lists: dict[Any, list[Atom]] = {}
    for atom, holds in atoms:
        if atom.member is not None and holds == any_of:
            lists.setdefault(atom.member[0], []).append(atom)
    terms, seen = [], set()
    for atom, holds in atoms:
        same = lists.get(atom.member[0], []) if atom.member is not None and holds == any_of else []
        if len(same) < LISTED:
            terms.append(atom.build() if holds else atom.negated())
        elif atom.member[0] not in seen:
            seen.add(atom.member[0])
            column, inside = atom.member[1], atom.member[1].isin(*[a.member[2] for a in same])
            terms.append(inside if holds else ~inside | column.isNull())
    terms += rest
    while len(terms) > 1:
        terms = [(a | b if any_of else a & b) for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]
