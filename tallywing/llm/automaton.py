"""Rules written as regexes, compiled together into one deterministic automaton over bytes.

Each rule becomes a nondeterministic automaton, and by subset construction a deterministic one that searches for the
leftmost match: a state holds the attempts still alive, oldest first, and a match drops those that began after it. The
rules' automata run side by side as one, whose states are minimised by partition refinement and laid out as one
transition array over classes of bytes. A state says which rules are inside a match, so one step a byte finds the matches
of all rules.

One pass is enough for rules whose match, once found, only grows until it ends, which end in a repeated class or in fixed
text; a rule of another kind is refused when it is compiled. Matches of a rule do not overlap: the next is looked for from
the end of the last, longest first from the leftmost start.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

#: Bytes that a lane of the scan goes through; lanes go side by side.
LANE = 512


class Rule(NamedTuple):
    """``kind`` of secret, its ``pattern`` over bytes, and the least bytes from the first that completes a match to the match's end."""

    kind: str
    pattern: str
    least: int


class Fragment:
    """Nondeterministic automaton of one pattern; state 0 starts, ``final`` accepts."""

    def __init__(self, pattern: str):
        self.free: list[list[int]] = [[]]
        self.steps: list[list[tuple[frozenset[int], int]]] = [[]]
        self.final = self.grow(parser.parse(pattern.encode("latin-1")), 0, False)

    def state(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def grow(self, tree, at: int, fold: bool) -> int:
        for op, arg in tree:
            if op in (sre.LITERAL, sre.IN, sre.NOT_LITERAL):
                chars = one_of([(op, arg)] if op != sre.IN else arg)
                if fold:
                    chars = chars | {c ^ 32 for c in chars if 65 <= (c & ~32) <= 90}
                then = self.state()
                self.steps[at].append((frozenset(chars), then))
                at = then
            elif op == sre.SUBPATTERN:
                _, add, drop, inner = arg
                at = self.grow(inner, at, (fold or bool(add & sre.SRE_FLAG_IGNORECASE)) and not drop & sre.SRE_FLAG_IGNORECASE)
            elif op == sre.BRANCH:
                then = self.state()
                for inner in arg[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.grow(inner, begin, fold)].append(then)
                at = then
            elif op == sre.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self.grow(inner, at, fold)
                if most == sre.MAXREPEAT:
                    begin, then = self.state(), self.state()
                    self.free[at] += [begin, then]
                    self.free[self.grow(inner, begin, fold)] += [begin, then]
                    at = then
                else:
                    then = self.state()
                    for _ in range(most - least):
                        self.free[at].append(then)
                        at = self.grow(inner, at, fold)
                    self.free[at].append(then)
                    at = then
            else:
                raise ValueError(f"{op} cannot be compiled to an automaton")
        return at

    def closed(self, states) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for then in self.free[left.pop()]:
                if then not in found:
                    found.add(then)
                    left.append(then)
        return frozenset(found)

    def moved(self, states, byte: int) -> frozenset[int]:
        return self.closed({then for s in states for chars, then in self.steps[s] if byte in chars})

    def backwards(self) -> Fragment:
        """The automaton of the reversed texts; its state 0 is this one's final."""
        other = Fragment.__new__(Fragment)
        name = {self.final: 0, 0: self.final}
        other.free, other.steps, other.final = [[] for _ in self.free], [[] for _ in self.free], self.final
        for s in range(len(self.free)):
            for then in self.free[s]:
                other.free[name.get(then, then)].append(name.get(s, s))
            for chars, then in self.steps[s]:
                other.steps[name.get(then, then)].append((chars, name.get(s, s)))
        return other


def one_of(items) -> set[int]:
    chars, negate = set(), False
    for op, arg in items:
        if op == sre.NEGATE:
            negate = True
        elif op == sre.LITERAL:
            chars.add(arg)
        elif op == sre.NOT_LITERAL:
            chars |= set(range(256)) - {arg}
        elif op == sre.RANGE:
            chars |= set(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"{op} cannot be compiled to an automaton")
    return set(range(256)) - chars if negate else chars


class Search:
    """Deterministic search for one rule, its states made as they are met.

    A state is (inside a match, attempts), attempts being sets of states of the fragment by age.
    """

    def __init__(self, rule: Rule):
        self.rule, self.fragment = rule, Fragment(rule.pattern)
        self.begin = self.fragment.closed({0})
        if self.fragment.final in self.begin:
            raise ValueError(f"rule {rule.kind} matches nothing at all")
        self.start = (False, ())
        self.known: dict[tuple, tuple] = {}

    def look(self, attempts, byte: int) -> tuple:
        final, seen, alive = self.fragment.final, frozenset(), []
        for states in (*attempts, self.begin):
            then = self.fragment.moved(states, byte) - seen
            if final in then:
                if alive:
                    raise ValueError(f"rule {self.rule.kind}: a match ends while an earlier one may still come")
                return True, (then,)
            if then:
                alive.append(then)
                seen |= then
        return False, tuple(alive)

    def step(self, state: tuple, byte: int) -> tuple:
        if (state, byte) in self.known:
            return self.known[state, byte]
        inside, attempts = state
        if not inside:
            new = self.look(attempts, byte)
        else:
            then = self.fragment.moved(attempts[0], byte)
            if then and self.fragment.final not in then:
                raise ValueError(f"rule {self.rule.kind}: a match may go on and fail")
            new = (True, (then,)) if then else self.look((), byte)
            if not then and new[0]:
                raise ValueError(f"rule {self.rule.kind}: matches may touch")
        self.known[state, byte] = new
        return new

    def lead(self, bytes_: Sequence[int]) -> int | None:
        """Bytes of a match up to the one that completes it, where all matches have the same."""
        level, n, seen = {self.begin}, 0, set()
        while level:
            n += 1
            then = {m for s in level for b in bytes_ if (m := self.fragment.moved(s, b))}
            if any(self.fragment.final in m for m in then):
                return n if all(self.fragment.final in m for m in then) else None
            if then & seen:
                return None
            seen |= then
            level = then
        return None


def byte_classes(fragments: Sequence[Fragment]) -> np.ndarray:
    """Class of each byte; bytes of a class are alike to every rule."""
    sets = sorted({tuple(sorted(chars)) for f in fragments for steps in f.steps for chars, _ in steps})
    member = np.zeros((256, len(sets)), bool)
    for k, chars in enumerate(sets):
        member[list(chars), k] = True
    return np.unique(member, axis=0, return_inverse=True)[1].astype(np.uint8).ravel()


class Automaton:
    """All rules in one transition array.

    ``next[state + class of the byte]`` is the next state, states being offsets of rows; ``inside[state]`` has a bit for
    each rule that is inside a match. State 0 is the start, to which the byte 0 leads from everywhere.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        searches = [Search(r) for r in rules]
        self.classes = byte_classes([s.fragment for s in searches])
        self.size = int(self.classes.max()) + 1
        example = [int(np.flatnonzero(self.classes == c)[0]) for c in range(self.size)]
        self.leads = [s.lead(example) for s in searches]
        self.back = [s.fragment.backwards() for s in searches]
        if any(s.fragment.moved(range(len(s.fragment.free)), 0) for s in searches):
            raise ValueError("no rule may match the byte 0, which ends a text")

        start = tuple(s.start for s in searches)
        place, order, table = {start: 0}, [start], []
        for state in order:  # grows while it is read
            row = []
            for byte in example:
                then = tuple(s.step(part, byte) for s, part in zip(searches, state))
                if then not in place:
                    place[then] = len(order)
                    order.append(then)
                row.append(place[then])
            table.append(row)
        inside = np.array([sum(1 << i for i, (found, _) in enumerate(state) if found) for state in order])
        group, table = self.minimal(np.array(table), inside)
        self.next = (table * self.size).astype(np.int32).ravel()
        self.inside = np.zeros(len(table) * self.size, np.uint16)
        self.inside[::self.size] = inside[np.unique(group, return_index=True)[1]]

    @staticmethod
    def minimal(table: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each state, equal states being in one, and the transitions between groups; group 0 holds state 0."""
        group = np.unique(output, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == group.max():
                break
            group = finer
        first = np.unique(group, return_index=True)[1]
        rank = np.argsort(np.argsort(first, kind="stable"), kind="stable")  # groups by their first state, so that state 0 is 0
        group = rank[group]
        return group, group[table[np.sort(first)]]

    def states(self, data: np.ndarray) -> np.ndarray:
        """State after each byte of ``data``, as (byte in the lane, lane).

        Lanes start as if at the start of a text; a lane whose predecessor ends elsewhere goes again from there until it
        meets the states it had, and so on until none is left, so lanes change nothing in the result.
        """
        lanes = max(1, -(-len(data) // LANE))
        padded = np.zeros(lanes * LANE, np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(self.classes[padded].reshape(lanes, LANE).T)
        out, state, follow = np.empty((LANE, lanes), np.int32), np.zeros(lanes, np.int32), self.next
        for i in range(LANE):
            state = follow[state + columns[i]]
            out[i] = state
        again = np.flatnonzero(out[-1, :-1]) + 1
        while len(again):
            state, alive = out[-1, again - 1], again
            for i in range(LANE):
                state = follow[state + columns[i, alive]]
                other = state != out[i, alive]
                alive, state = alive[other], state[other]
                if not len(alive):
                    break
                out[i, alive] = state
            again = alive[alive + 1 < lanes] + 1
        return out

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rule, start, end) of the matches in ``data``, whose texts end in a byte 0 each, by start and then rule."""
        flags = np.append(self.inside[self.states(data)].T.ravel()[: len(data)], np.uint16(0))
        turn = np.flatnonzero(flags[1:] != flags[:-1]) + 1
        if flags[0]:
            turn = np.concatenate(([0], turn))
        now = flags[turn]
        turned = now ^ np.concatenate((np.zeros(1, np.uint16), now[:-1]))
        found = []
        for r, rule in enumerate(self.rules):
            mine = (turned >> r) & 1 == 1
            places, on = turn[mine], (now[mine] >> r) & 1 == 1
            rise, fall = places[on], places[~on]
            k = np.flatnonzero(fall - rise >= rule.least)
            if self.leads[r] is not None:
                start = rise[k] - (self.leads[r] - 1)
            else:
                start = np.array([self.first(r, data, int(rise[i]), int(fall[i - 1]) if i else 0) for i in k.tolist()], np.int64)
            found.append((np.full(len(k), r), start, fall[k]))
        rules, starts, ends = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((rules, starts))
        return rules[order], starts[order], ends[order]

    def first(self, r: int, data: np.ndarray, last: int, least: int) -> int:
        """Leftmost start, at ``least`` or later, of a match of rule ``r`` that the byte at ``last`` completes."""
        back, at, start = self.back[r], last, last
        states = back.closed({0})
        while at >= least and (states := back.moved(states, int(data[at]))):
            if back.final in states:
                start = at
            at -= 1
        return start
