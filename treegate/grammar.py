"""Compiled grammars: productions as patterns, checked and normalised."""

from __future__ import annotations

import hashlib

from treegate import patterns as P
from treegate.errors import GrammarError
from treegate.patterns import Pattern


class Grammar:
    """Productions by name; ``main`` is where a record starts."""

    def __init__(self, trees: dict[str, tuple]):
        if "main" not in trees:
            raise GrammarError("no production named main")
        self.trees = trees
        nullable = {}
        for name in trees:
            self._check(trees[name], {name})
        for name in trees:
            nullable[name] = self._nullable(trees[name])
        self.productions: dict[str, Pattern] = {}
        self._known = nullable
        for name, tree in trees.items():
            self.productions[name] = self._build(tree)

    @property
    def main(self) -> Pattern:
        return self.productions["main"]

    def _tree(self, name: str) -> tuple:
        if name not in self.trees:
            raise GrammarError(f"no reference named: {name}")
        return self.trees[name]

    def _check(self, tree: tuple, open_names: set[str]) -> None:
        """Raises where a production comes back to itself without a node between."""
        op = tree[0]
        if op == "ref":
            if tree[1] in open_names:
                raise GrammarError(f"recursion without interleaved treenode not supported: {tree[1]}")
            self._check(self._tree(tree[1]), open_names | {tree[1]})
        elif op == "concat":
            self._check(tree[1], open_names)
            if self._nullable(tree[1]):
                self._check(tree[2], open_names)
            else:
                self._names(tree[2])
        elif op == "node":
            self._names(tree[2])
        else:
            for part in tree[1:]:
                self._check(part, open_names)

    def _names(self, tree: tuple) -> None:
        """Raises where a name below has no production."""
        if tree[0] == "ref":
            self._tree(tree[1])
        elif tree[0] == "node":
            self._names(tree[2])
        else:
            for part in tree[1:]:
                self._names(part)

    def _nullable(self, tree: tuple) -> bool:
        op = tree[0]
        if op in ("empty", "any", "star", "optional"):
            return True
        if op == "node":
            return False
        if op == "ref":
            return self._nullable(self._tree(tree[1]))
        if op == "not":
            return not self._nullable(tree[1])
        if op == "contains":
            return self._nullable(tree[1])
        parts = [self._nullable(x) for x in tree[1:]]
        return any(parts) if op == "or" else all(parts)

    def _build(self, tree: tuple) -> Pattern:
        op = tree[0]
        if op == "empty":
            return P.EMPTY
        if op == "any":
            return P.ANY
        if op == "node":
            return P.node(tree[1], self._build(tree[2]))
        if op == "ref":
            return P.reference(tree[1], self._known[tree[1]])
        parts = [self._build(x) for x in tree[1:]]
        match op:
            case "or":
                return P.union(parts)
            case "and":
                return P.intersection(parts)
            case "concat":
                return P.concat(*parts)
            case "interleave":
                return P.interleave(parts)
            case "star":
                return P.star(parts[0])
            case "optional":
                return P.optional(parts[0])
            case "contains":
                return P.contains(parts[0])
        return P.negate(parts[0])

    def __str__(self) -> str:
        return " ".join(f"#{name} = {p}" for name, p in self.productions.items())

    def key(self) -> str:
        """A digest of the text, by which workers keep automata."""
        return hashlib.sha256(str(self).encode()).hexdigest()

    def _named(self) -> dict[str, set[str]]:
        """The names in each production."""
        out = {}
        for name, p in self.productions.items():
            out[name], todo = set(), [p]
            while todo:
                q = todo.pop()
                todo.extend(q.parts)
                if q.op == "ref":
                    out[name].add(q.name)
        return out

    def names_main(self) -> bool:
        """Whether a production refers to ``main``."""
        return any("main" in names for names in self._named().values())

    def is_recursive(self) -> bool:
        """Whether some production reaches itself (below a node)."""
        direct = self._named()
        for name in direct:
            seen, todo = set(), set(direct[name])
            while todo:
                n = todo.pop()
                if n == name:
                    return True
                if n not in seen:
                    seen.add(n)
                    todo |= direct[n]
        return False
