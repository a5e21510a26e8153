"""Derivatives of patterns, straight from their definition: the oracle that the engines are tested against.

The derivative of a pattern by a tree accepts what may follow that tree.  A node takes
a tree if its expression holds for the label and its own pattern accepts the children,
which is asked right there, by derivatives of their own.  No engine uses this module.
Both functions raise :class:`RecordError` for a label that cannot be read.
"""

from __future__ import annotations

from treegate import patterns as P
from treegate.errors import RecordError
from treegate.grammar import Grammar
from treegate.labels import Tree
from treegate.patterns import Pattern


class _Derivation:
    """``known``: derivatives by the trees that are open, by pattern and tree; None: nothing is kept."""

    def __init__(self, g: Grammar, known: dict[tuple[Pattern, int], Pattern] | None):
        self.g, self.known = g, known

    def forest(self, p: Pattern, trees: list[Tree]) -> Pattern:
        for tree in trees:
            if P.is_settled(p):
                break
            p = self.tree(p, tree)
        return p

    def tree(self, p: Pattern, tree: Tree) -> Pattern:
        if self.known is None:
            return self.plain(p, tree)
        key = (p, id(tree))
        if key not in self.known:
            self.known[key] = self.plain(p, tree)
        return self.known[key]

    def plain(self, p: Pattern, tree: Tree) -> Pattern:
        match p.op:
            case "empty":
                return P.NONE
            case "any":
                return P.ANY
            case "node":
                label, children = tree
                return P.EMPTY if p.expr.eval(label) and self.forest(p.parts[0], children).nullable else P.NONE
            case "ref":
                return self.tree(self.g.productions[p.name], tree)
            case "not":
                return P.negate(self.tree(p.parts[0], tree))
            case "optional":
                return self.tree(p.parts[0], tree)
            case "star":
                return P.concat(self.tree(p.parts[0], tree), p)
            case "contains":  # the tree is part of what is looked for, or stands in a gap
                return P.union([P.contains(self.tree(p.parts[0], tree)), p])
            case "or":
                return P.union([self.tree(q, tree) for q in p.parts])
            case "and":
                return P.intersection([self.tree(q, tree) for q in p.parts])
            case "concat":
                head, tail = p.parts
                ways = [P.concat(self.tree(head, tree), tail)]
                if head.nullable:
                    ways.append(self.tree(tail, tree))
                return P.union(ways)
        # interleave: the tree belongs to one of the parts, the others wait
        return P.union([P.interleave([*p.parts[:i], self.tree(q, tree), *p.parts[i + 1 :]]) for i, q in enumerate(p.parts)])


def derive(g: Grammar, forest: list[Tree]) -> Pattern:
    """The residual pattern of a record."""
    return _Derivation(g, None).forest(g.main, forest)


def shared_derive(g: Grammar, forest: list[Tree]) -> Pattern:
    """As :func:`derive`; equal patterns that meet one tree are derived once."""
    return _Derivation(g, {}).forest(g.main, forest)


def accepts(g: Grammar, forest: list[Tree], shared: bool = False) -> bool:
    """Whether the record is accepted; an unreadable label rejects it."""
    try:
        return (shared_derive if shared else derive)(g, forest).nullable
    except RecordError:
        return False
