"""Regular grammars as one deterministic automaton.

The grammars' parse trees become one non-deterministic automaton; its sets of states are made deterministic as they are
met, one table entry per (set, character), so a text is read once per place whatever the number of grammars.  What a
grammar asks of the character after its match (a word boundary, a class that must not follow) is checked where it accepts.
"""

from __future__ import annotations

import re
from re import _constants as C  # noqa: PLC2701
from re import _parser as P  # noqa: PLC2701

_WORD = re.compile(r"\w")
_CATEGORY = {C.CATEGORY_WORD: r"\w", C.CATEGORY_DIGIT: r"\d", C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_WORD: r"\W", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_NOT_SPACE: r"\S"}


def _in_class(items: list, c: str) -> bool:
    negate = items[0][0] is C.NEGATE
    for op, v in items[1:] if negate else items:
        if op is C.LITERAL and ord(c) == v or op is C.RANGE and v[0] <= ord(c) <= v[1] or op is C.CATEGORY and re.match(_CATEGORY[v], c):
            return not negate
    return negate


class Automaton:
    def __init__(self, grammars: list[str]):
        self.step: list[list[tuple[object, int]]] = []  # state -> [(class, state)]
        self.free: list[list[int]] = []
        self.accept: dict[int, int] = {}
        self.after: list[list] = []
        begin = self._state()
        for i, g in enumerate(grammars):
            tree = list(P.parse(g))
            tail = []
            while tree and tree[-1][0] in (C.AT, C.ASSERT_NOT):
                tail.append(tree.pop())
            self.after.append(tail)
            first = self._state()
            self.free[begin].append(first)
            self.accept[self._add(tree, first)] = i
        self.table: dict[tuple[int, str], int] = {}
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.ends: list[tuple[int, ...]] = []
        self.start = self._known(self._closure({begin}))

    def _state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def _add(self, tree: list, at: int) -> int:
        for op, v in tree:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                to = self._state()
                what = {C.LITERAL: [(C.LITERAL, v)], C.NOT_LITERAL: [(C.NEGATE, None), (C.LITERAL, v)], C.IN: v, C.ANY: [(C.NEGATE, None), (C.LITERAL, 10)]}[op]
                self.step[at].append((what, to))
                at = to
            elif op is C.SUBPATTERN:
                at = self._add(list(v[3]), at)
            elif op is C.BRANCH:
                to = self._state()
                for part in v[1]:
                    begin = self._state()
                    self.free[at].append(begin)
                    self.free[self._add(list(part), begin)].append(to)
                at = to
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, part = v
                for _ in range(least):
                    at = self._add(list(part), at)
                if most is C.MAXREPEAT:
                    loop = self._state()
                    self.free[at].append(loop)
                    self.free[self._add(list(part), loop)].append(loop)
                    at = loop
                else:
                    to = self._state()
                    for _ in range(most - least):
                        self.free[at].append(to)
                        at = self._add(list(part), at)
                    self.free[at].append(to)
                    at = to
            else:
                raise ValueError(f"{op} is not regular here")
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    def _known(self, states: frozenset) -> int:
        n = self.number.get(states)
        if n is None:
            n = self.number[states] = len(self.sets)
            self.sets.append(states)
            self.ends.append(tuple(sorted(self.accept[s] for s in states if s in self.accept)))
        return n

    def _next(self, now: int, c: str) -> int:
        to = self._closure({t for s in self.sets[now] for what, t in self.step[s] if _in_class(what, c)})
        n = self.table[now, c] = self._known(to) if to else -1
        return n

    def _follows(self, i: int, text: str, end: int) -> bool:
        after = text[end : end + 1]
        for op, v in self.after[i]:
            if op is C.AT:
                if bool(_WORD.match(after)) == bool(_WORD.match(text[end - 1])):
                    return False
            elif after and _in_class(v[1][0][1] if v[1][0][0] is C.IN else [v[1][0]], after):
                return False
        return True

    def match(self, text: str, at: int) -> dict[int, int]:
        """For every grammar that matches from ``at`` on the end of its longest match."""
        now, table, out = self.start, self.table, {}
        for end in range(at, len(text)):
            c = text[end]
            to = table.get((now, c))
            now = self._next(now, c) if to is None else to
            if now < 0:
                break
            for i in self.ends[now]:
                if self._follows(i, text, end + 1):
                    out[i] = end + 1
        return out
