"""Regular expressions compiled to minimal deterministic automata over bytes.

A rule set becomes one automaton: Thompson construction per rule, subset construction over the union,
and minimisation by partition refinement. Transitions are a flat list indexed by state * 256 + byte.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[set[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append(set())
        self.moves.append([])
        return len(self.moves) - 1

    def add(self, pattern: Iterable, at: int, fold: bool, backward: bool) -> int:
        """Append a parsed pattern after state `at`; returns the state where it ends."""
        pattern = list(pattern)
        for kind, value in reversed(pattern) if backward else pattern:
            at = self._add(kind, value, at, fold, backward)
        return at

    def _add(self, kind, value, at: int, fold: bool, backward: bool) -> int:
        if kind in (sre.LITERAL, sre.IN):
            end = self.state()
            self.moves[at].append((_bytes(kind, value, fold), end))
            return end
        if kind is sre.SUBPATTERN:
            return self.add(value[-1], at, fold, backward)
        if kind is sre.BRANCH:
            end = self.state()
            for choice in value[1]:
                self.empty[self.add(choice, at, fold, backward)].add(end)
            return end
        if kind is sre.MAX_REPEAT:
            low, high, inner = value
            for _ in range(low):
                at = self.add(inner, at, fold, backward)
            end = self.state()
            self.empty[at].add(end)
            if high is sre.MAXREPEAT:
                self.empty[self.add(inner, end, fold, backward)].add(end)
            else:
                for _ in range(high - low):
                    at = self.add(inner, at, fold, backward)
                    self.empty[at].add(end)
            return end
        raise ValueError(f"patterns of kind {kind} are not supported")

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, open_ = set(states), list(states)
        while open_:
            for x in self.empty[open_.pop()] - seen:
                seen.add(x)
                open_.append(x)
        return frozenset(seen)


def _bytes(kind, value, fold: bool) -> frozenset[int]:
    found: set[int] = set()
    for k, v in [(kind, value)] if kind is sre.LITERAL else value:
        found |= {v} if k is sre.LITERAL else set(range(v[0], v[1] + 1)) if k is sre.RANGE else set()
        if k not in (sre.LITERAL, sre.RANGE):
            raise ValueError(f"class members of kind {k} are not supported")
    if max(found) > 127:
        raise ValueError("rules match ASCII bytes")
    if fold:
        found |= {ord(chr(x).swapcase()) for x in found}
    return frozenset(found)


@dataclass(frozen=True)
class Dfa:
    """`step[state * 256 + byte]` is the next state times 256; `accepts[state]` has a bit per rule.

    States that accept nothing come first: a value of at least `first_accept` is a hit. From the state
    `dead` (times 256; -1 if there is none) nothing can be accepted any more.
    """

    step: list[int]
    accepts: list[int]
    start: int
    first_accept: int
    dead: int

    def longest(self, data: bytes, at: int) -> int:
        """Where the longest match that starts at `at` ends, or -1."""
        state, step, found = self.start, self.step, -1
        for i in range(at, len(data)):
            state = step[state + data[i]]
            if state == self.dead:
                break
            if state >= self.first_accept:
                found = i + 1
        return found


def compile_rules(patterns: list[list[tuple[str, bool]]], backward: bool = False, anywhere: bool = False) -> Dfa:
    """One automaton of all rules; a rule is a list of (pattern, ignore case) parts in a row.

    backward: it reads the text from its end. anywhere: a match may begin at every byte.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for n, parts in enumerate(patterns):
        at = nfa.state()
        nfa.empty[root].add(at)
        for pattern, fold in reversed(parts) if backward else parts:
            at = nfa.add(sre_parser.parse(pattern), at, fold, backward)
        ends[at] = 1 << n
    classes, sample = _byte_classes(nfa)

    start = nfa.closure([root])
    known, todo, rows = {start: 0}, [start], []
    for states in todo:  # grows while it runs
        row = []
        for byte in sample:
            to = {t for s in states for chars, t in nfa.moves[s] if byte in chars}
            to = nfa.closure(to | {root} if anywhere else to)
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        rows.append(row)
    accepts = np.array([sum(ends.get(s, 0) for s in states) for states in todo])
    return _minimal(np.array(rows), accepts, classes)


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that no transition tells apart share a class; one byte stands for each class."""
    sets = sorted({chars for moves in nfa.moves for chars, _ in moves}, key=sorted)
    marks = [tuple(b in s for s in sets) for b in range(256)]
    names: dict[tuple, int] = {}
    classes = np.array([names.setdefault(m, len(names)) for m in marks])
    return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(names))]


def _minimal(rows: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Dfa:
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    members = np.unique(block, return_index=True)[1]
    order = np.argsort(accepts[members] != 0, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    members = members[order]
    to = place[block[rows[members]]]
    kept = accepts[members]
    still = [i for i in range(len(members)) if not kept[i] and (to[i] == i).all()]
    return Dfa((to[:, classes] * 256).ravel().tolist(), kept.tolist(), int(place[block[0]]) * 256, int((kept == 0).sum()) * 256, still[0] * 256 if still else -1)
