"""A pattern's step over one tree, split in two for engines that don't hold whole records.

``asked`` gives the nodes whose verdict on the tree counts; ``follow`` gives what comes
after the tree, once it is known which of them took it.  Patterns are interned, so a node
is its own key, and nodes that are equal are asked once.
"""

from __future__ import annotations

from collections.abc import Callable

from treegate import patterns as P
from treegate.grammar import Grammar
from treegate.patterns import Pattern


def asked(g: Grammar, p: Pattern) -> tuple[Pattern, ...]:
    """The distinct nodes that the next tree may be."""
    found: dict[Pattern, None] = {}
    todo = [p]
    while todo:
        q = todo.pop()
        if q.op == "node":
            found[q] = None
        elif q.op == "ref":
            todo.append(g.productions[q.name])
        elif q.op == "concat":
            todo.extend(q.parts if q.parts[0].nullable else q.parts[:1])
        else:
            todo.extend(q.parts)
    return tuple(found)


def level(g: Grammar, p: Pattern) -> tuple[Pattern, ...]:
    """The distinct nodes that any later tree of the same forest may be: those of all residuals."""
    found: dict[Pattern, None] = {}
    names: set[str] = set()
    todo = [p]
    while todo:
        q = todo.pop()
        if q.op == "node":
            found[q] = None
        elif q.op != "ref":
            todo.extend(q.parts)
        elif q.name not in names:
            names.add(q.name)
            todo.append(g.productions[q.name])
    return tuple(found)


def follow(g: Grammar, p: Pattern, took: Callable[[Pattern], bool]) -> Pattern:
    """What follows a tree, of which ``took`` says whether a node of ``asked`` takes it."""

    def after(q: Pattern) -> Pattern:
        match q.op:
            case "node":
                return P.EMPTY if took(q) else P.NONE
            case "empty":
                return P.NONE
            case "any":
                return q
            case "ref":
                return after(g.productions[q.name])
            case "optional":
                return after(q.parts[0])
            case "not":
                return P.negate(after(q.parts[0]))
            case "star":
                return P.concat(after(q.parts[0]), q)
            case "contains":
                return P.union([q, P.contains(after(q.parts[0]))])
            case "or":
                return P.union(list(map(after, q.parts)))
            case "and":
                return P.intersection(list(map(after, q.parts)))
            case "concat":
                first = P.concat(after(q.parts[0]), q.parts[1])
                return P.union([first, after(q.parts[1])]) if q.parts[0].nullable else first
        return P.union([P.interleave([after(x), *(y for j, y in enumerate(q.parts) if j != i)]) for i, x in enumerate(q.parts)])

    return after(p)
