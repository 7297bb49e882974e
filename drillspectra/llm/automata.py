"""Rule expressions over ASCII as minimal deterministic automata, and their scan over flat bytes.

The combined automaton reads the bytes once, from right to left, and tells for each byte which rules
have a match that starts there. A match is then followed from its start by the rule's own automaton.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Bytes of a lane when the lanes of a slice are scanned side by side, and the least number worth it.
LANE = 256
FEW_LANES = 48


class _Fragments:
    """Nondeterministic automaton: byte sets and empty moves between numbered places."""

    def __init__(self, backwards: bool):
        self.moves: list[tuple[frozenset[int] | None, int]] = []
        self.empty: list[list[int]] = []
        self.backwards = backwards

    def place(self) -> int:
        self.moves.append((None, 0))
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """The place behind ``tree`` when it is read from ``start``."""
        for kind, value in reversed(tree) if self.backwards else tree:
            start = self._one(str(kind), value, start)
        return start

    def _one(self, kind: str, value, start: int) -> int:
        if kind in ("LITERAL", "IN"):
            stop = self.place()
            self.moves[start] = (frozenset([value]) if kind == "LITERAL" else _members(value), stop)
            stop_empty = self.place()
            self.empty[stop].append(stop_empty)
            return stop_empty
        if kind == "SUBPATTERN":
            return self.add(value[3], start)
        if kind == "BRANCH":
            stop = self.place()
            for branch in value[1]:
                begin = self.place()
                self.empty[start].append(begin)
                self.empty[self.add(branch, begin)].append(stop)
            after = self.place()
            self.empty[stop].append(after)
            return after
        if kind == "MAX_REPEAT":
            least, most, inner = value
            for _ in range(least):
                start = self.add(inner, start)
            stop = self.place()
            if most is re._parser.MAXREPEAT:
                loop = self.place()
                self.empty[start].append(loop)
                inside = self.place()
                self.empty[loop] += [inside, stop]
                self.empty[self.add(inner, inside)].append(loop)
            else:
                self.empty[start].append(stop)
                for _ in range(most - least):
                    inside = self.place()
                    self.empty[start].append(inside)
                    start = self.add(inner, inside)
                    self.empty[start].append(stop)
            after = self.place()
            self.empty[stop].append(after)
            return after
        raise ValueError(f"a rule may not hold {kind}")


def _members(items) -> frozenset[int]:
    out: set[int] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            out.add(value)
        elif str(kind) == "RANGE":
            out |= set(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"a set may not hold {kind}")
    if max(out) > 127:
        raise ValueError("rules are ASCII")
    return frozenset(out)


class Automaton:
    """``table[state, byte class]``, ``classes[byte]`` and ``accepts[state]`` (a bit for each rule); state 0 starts.

    With ``anywhere`` a match may begin at every byte read; ``backwards`` reads the rules from their ends.
    ``resets`` are the bytes that lead from every state to the start, so a scan may begin behind them.
    """

    def __init__(self, patterns: tuple[str, ...], backwards: bool = False, anywhere: bool = False):
        nfa = _Fragments(backwards)
        starts, finals = [], {}
        for number, pattern in enumerate(patterns):
            start = nfa.place()
            starts.append(start)
            finals[nfa.add(list(re._parser.parse(pattern)), start)] = number
        sets = {move[0] for move in nfa.moves if move[0]}
        patterns_of_bytes: dict[tuple, int] = {}
        self.classes = np.array([patterns_of_bytes.setdefault(tuple(b in s for s in sets), len(patterns_of_bytes)) for b in range(256)], np.int64)
        example = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(patterns_of_bytes))]

        def closed(places) -> frozenset[int]:
            seen, todo = set(places), list(places)
            while todo:
                for other in nfa.empty[todo.pop()]:
                    if other not in seen:
                        seen.add(other)
                        todo.append(other)
            return frozenset(p for p in seen if nfa.moves[p][0] or p in finals)

        first = closed(starts)
        again = first if anywhere else frozenset()
        number = {first: 0}
        rows, todo = [], [first]
        for state in todo:  # subset construction; ``todo`` grows while it is read
            row = []
            for byte in example:
                after = closed([nfa.moves[p][1] for p in state if nfa.moves[p][0] and byte in nfa.moves[p][0]]) | again
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            rows.append(row)
        accepts = np.array([sum(1 << r for p, r in finals.items() if p in state) for state in todo], np.int64)
        table = np.array(rows, np.int64)
        block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
        while True:  # split blocks of states until all states of a block move alike
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        order = np.full(block.max() + 1, -1)
        order[block[0]] = 0  # the start keeps number 0
        order[order < 0] = np.arange(1, block.max() + 1)
        member = np.zeros(block.max() + 1, np.int64)
        member[order[block]] = np.arange(len(block))
        self.table = order[block[table[member]]]
        self.accepts = accepts[member].astype(np.int32)
        dead = (self.accepts == 0) & (self.table == np.arange(len(member))[:, None]).all(axis=1)
        self.dead = int(np.flatnonzero(dead)[0]) if dead.any() else -1
        self.resets = (self.table == 0).all(axis=0)[self.classes]
        self.steps = [[int(row[c]) for c in self.classes] for row in self.table]  # for single lanes

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """End of the longest match that starts at ``start``, or -1."""
        state, found, steps, accepts, dead = 0, -1, self.steps, self.accepts.tolist(), self.dead
        for at in range(start, stop):
            state = steps[state][data[at]]
            if state == dead:
                break
            if accepts[state]:
                found = at + 1
        return found

    def marks_backwards(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Rule bits of every byte of rows ``raw[borders[i]:borders[i + 1]]``, each read from its end."""
        marks = np.zeros(len(raw), np.int32)
        if len(raw) == 0:
            return marks
        resets = np.flatnonzero(self.resets[raw])
        wanted = np.searchsorted(resets, np.arange(LANE, len(raw), LANE))
        cuts = resets[wanted[wanted < len(resets)]]
        ends = np.unique(np.concatenate([cuts, borders[1:][borders[1:] > borders[:-1]]]))
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        starts, ends, size = starts[order], ends[order], size[order]
        kinds = self.classes[raw]
        flat, width = self.table.reshape(-1), self.table.shape[1]
        state = np.zeros(len(size), np.int64)
        live = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) + 1), side="right")
        step = 0
        while step < size[0] and live[step] >= FEW_LANES:
            n = live[step]
            at = ends[:n] - step - 1
            state[:n] = flat[state[:n] * width + kinds[at]]
            marks[at] = self.accepts[state[:n]]
            step += 1
        if step < size[0]:
            data, steps, accepts = raw.tobytes(), self.steps, self.accepts.tolist()
            for lane in range(live[step]):
                now = int(state[lane])
                for at in range(int(ends[lane]) - step - 1, int(starts[lane]) - 1, -1):
                    now = steps[now][data[at]]
                    if accepts[now]:
                        marks[at] = accepts[now]
        return marks


@lru_cache(maxsize=8)
def starts_of(patterns: tuple[str, ...]) -> Automaton:
    """All rules at once, from right to left."""
    return Automaton(patterns, backwards=True, anywhere=True)


@lru_cache(maxsize=64)
def one_rule(pattern: str) -> Automaton:
    return Automaton((pattern,))


def matches(patterns: tuple[str, ...], raw: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(row, start, stop, rule)``: per rule and row, leftmost longest matches that do not overlap."""
    marks = starts_of(patterns).marks_backwards(raw, borders)
    some = np.flatnonzero(marks)
    if len(some) == 0:
        return []
    data, out = raw.tobytes(), []
    for number, pattern in enumerate(patterns):
        places = some[(marks[some] >> number) & 1 == 1]
        rule, next_place = one_rule(pattern), 0
        while next_place < len(places):
            start = int(places[next_place])
            row = int(np.searchsorted(borders, start, side="right")) - 1
            stop = rule.longest(data, start, int(borders[row + 1]))
            out.append((row, start, stop, number))
            next_place = int(np.searchsorted(places, stop))
    return out
