"""A lazily built visibly-pushdown automaton over forests.

A state is a list of patterns, numbered when first met.  Opening a tree moves to the
state of what its children must match, which depends on the truth of the state's label
conditions; the state left and those truths go on a stack.  Closing it looks up the state
that follows, from both and from which patterns of the inner state accept.  The tables
fill as records come and are shared by all records of a worker; tables over ``LIMIT``
entries start afresh.  The walk uses its own stack, so depth is
bounded by memory alone, and skips what cannot change an answer.
"""

from __future__ import annotations

from treegate import patterns as P
from treegate import steps
from treegate.errors import RecordError
from treegate.grammar import Grammar
from treegate.labels import Label, Tree
from treegate.patterns import Pattern

LIMIT = 200_000


class Automaton:
    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.states: list[list[Pattern]] = []
        self.asks: list[tuple[list[tuple[Pattern, ...]], list] | None] = []
        self.opened: dict[tuple[int, tuple[bool, ...]], tuple[int, tuple[Pattern, ...]]] = {}
        self.closed: dict[tuple[int, tuple[bool, ...], tuple[bool, ...]], int] = {}
        self.settled: list[bool] = []
        self.bits: list[tuple[bool, ...]] = []
        self.start = self._state([self.grammar.main])

    def _state(self, ps: list[Pattern]) -> int:
        key = tuple(p.serial for p in ps)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(ps)
            self.asks.append(None)
            self.settled.append(all(P.is_settled(p) for p in ps))
            self.bits.append(tuple(p.nullable for p in ps))
        return number

    def _asks(self, state: int):
        """The nodes that each pattern of the state asks, and their distinct conditions."""
        found = self.asks[state]
        if found is None:
            nodes = [steps.asked(self.grammar, p) for p in self.states[state]]
            found = self.asks[state] = (nodes, list(dict.fromkeys(n.expr for ns in nodes for n in ns)))
        return found

    def open(self, state: int, label: Label) -> tuple[int, tuple[bool, ...]]:
        """The state for the children, and the truths of the state's conditions."""
        nodes, conditions = self._asks(state)
        truths = tuple([bool(e.eval(label)) for e in conditions])
        found = self.opened.get((state, truths))
        if found is None:
            true = dict(zip(conditions, truths, strict=True))
            inside = dict.fromkeys(n.parts[0] for ns in nodes for n in ns if true[n.expr] and not P.is_settled(n.parts[0]))
            found = self.opened[state, truths] = (self._state(list(inside)), tuple(inside))
        return found[0], truths

    def close(self, state: int, truths: tuple[bool, ...], inside: int) -> int:
        """The state after the tree."""
        key = (state, truths, self.bits[inside])
        found = self.closed.get(key)
        if found is None:
            true = dict(zip(self._asks(state)[1], truths, strict=True))
            accepted = dict(zip(self.opened[state, truths][1], self.bits[inside], strict=True)) | {P.ANY: True, P.NONE: False}
            found = self.closed[key] = self._state([steps.follow(self.grammar, p, lambda n: true[n.expr] and accepted[n.parts[0]]) for p in self.states[state]])
        return found

    def run(self, forest: list[Tree]) -> Pattern:
        """The residual pattern of a record."""
        if len(self.opened) + len(self.closed) > LIMIT:
            self._reset()
        state = self.start
        stack: list[tuple[int, tuple[bool, ...], list[Tree], int]] = []
        trees, i = forest, 0
        while True:
            if i < len(trees) and not self.settled[state]:
                label, children = trees[i]
                inside, truths = self.open(state, label)
                stack.append((state, truths, trees, i + 1))
                state, trees, i = inside, children, 0
                continue
            if not stack:
                return self.states[state][0]
            before, truths, trees, i = stack.pop()
            state = self.close(before, truths, state)

    def accepts(self, forest: list[Tree]) -> bool:
        try:
            return self.run(forest).nullable
        except RecordError:
            return False


_automata: dict[str, Automaton] = {}


def automaton(grammar: Grammar, key: str) -> Automaton:
    """This worker's automaton of a grammar."""
    found = _automata.get(key)
    if found is None:
        if len(_automata) >= 64:
            _automata.clear()
        found = _automata[key] = Automaton(grammar)
    return found
