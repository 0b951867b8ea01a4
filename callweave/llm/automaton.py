"""Regular expressions to one minimal byte automaton for all rules.

A rule's expression is parsed to a Thompson NFA over bytes.  `compile_rules` joins the
reversed NFAs of all rules behind a loop over any byte, makes it deterministic by
subset construction over byte classes, minimises it by partition refinement and
returns transition arrays.  Read backwards over a text, the state after a byte
tells for every rule whether a match *starts* there.

Supported: literals, escapes (\\xHH, \\d, \\w, punctuation), classes with ranges
and negation, groups, |, ?, *, +, {n}, {n,}, {n,m}.  Matches are leftmost-longest.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

ALL = frozenset(range(256))


class _Parser:
    """Recursive descent to a tree of ('set', bytes) / ('cat', parts) / ('alt', parts) / ('rep', part, low, high)."""

    def __init__(self, text: str, ignore_case: bool):
        self.s, self.i, self.ic = text.encode(), 0, ignore_case

    def peek(self) -> int:
        return self.s[self.i] if self.i < len(self.s) else -1

    def take(self) -> int:
        self.i += 1
        return self.s[self.i - 1]

    def fold(self, chars: frozenset) -> frozenset:
        if not self.ic:
            return chars
        return chars | {c ^ 32 for c in chars if 65 <= c <= 90 or 97 <= c <= 122}

    def alt(self):
        parts = [self.cat()]
        while self.peek() == ord("|"):
            self.take()
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() not in (-1, ord("|"), ord(")")):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) != -1 and c in b"?*+{":
            self.take()
            low, high = {63: (0, 1), 42: (0, None), 43: (1, None)}.get(c, (None, None))
            if c == ord("{"):
                body = b""
                while (d := self.take()) != ord("}"):
                    body += bytes([d])
                a, comma, b = body.partition(b",")
                low, high = int(a), int(b) if b else (None if comma else int(a))
            node = ("rep", node, low, high)
        return node

    def escape(self) -> frozenset:
        c = self.take()
        if c == ord("x"):
            return frozenset([int(bytes([self.take(), self.take()]), 16)])
        if c == ord("d"):
            return frozenset(range(48, 58))
        if c == ord("w"):
            return frozenset([*range(48, 58), *range(65, 91), 95, *range(97, 123)])
        return frozenset([{ord("t"): 9, ord("n"): 10, ord("r"): 13}.get(c, c)])

    def atom(self):
        c = self.take()
        if c == ord("("):
            if self.s[self.i : self.i + 2] == b"?:":
                self.i += 2
            node = self.alt()
            self.take()
            return node
        if c == ord("["):
            return ("set", self.fold(self.char_class()))
        if c == ord("."):
            return ("set", ALL - {10})
        return ("set", self.fold(self.escape() if c == ord("\\") else frozenset([c])))

    def char_class(self) -> frozenset:
        negate = self.peek() == ord("^")
        if negate:
            self.take()
        chars: set = set()
        first = True
        while first or self.peek() != ord("]"):
            first = False
            c = self.take()
            got = self.escape() if c == ord("\\") else frozenset([c])
            if self.peek() == ord("-") and self.s[self.i + 1] != ord("]") and len(got) == 1:
                self.take()
                d = self.take()
                high = min(self.escape()) if d == ord("\\") else d
                got = frozenset(range(min(got), high + 1))
            chars |= got
        self.take()
        return ALL - chars if negate else frozenset(chars)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.step: list[tuple[frozenset, int] | None] = []

    def new(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def build(self, node, backwards: bool) -> tuple[int, int]:
        kind = node[0]
        a, b = self.new(), self.new()
        if kind == "set":
            self.step[a] = (node[1], b)
        elif kind == "cat":
            at = a
            for part in reversed(node[1]) if backwards else node[1]:
                s, e = self.build(part, backwards)
                self.free[at].append(s)
                at = e
            self.free[at].append(b)
        elif kind == "alt":
            for part in node[1]:
                s, e = self.build(part, backwards)
                self.free[a].append(s)
                self.free[e].append(b)
        else:
            _, part, low, high = node
            at = a
            for _ in range(low):
                s, e = self.build(part, backwards)
                self.free[at].append(s)
                at = e
            if high is None:
                s, e = self.build(part, backwards)
                self.free[at] += [s, b]
                self.free[e] += [s, b]
            else:
                for _ in range(high - low):
                    s, e = self.build(part, backwards)
                    self.free[at] += [s, b]
                    at = e
                self.free[at].append(b)
        return a, b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """rows[state][byte] is the next state; states from `first_hit` up accept, and accepts[state] has the rules' numbers."""

    rows: list[list[int]]
    first_hit: int
    accepts: list[frozenset]


def _determinise(nfa: _Nfa, start: frozenset, final: dict[int, int]) -> tuple[list[list[int]], list[frozenset], list[int]]:
    """Subset construction.  A subset is an integer with a bit for each state that reads a byte or ends a rule.

    States that read the same byte set move together: a subset's moves are worked
    out once for each of the few sets, then joined for the byte classes.
    """
    groups: dict[frozenset, int] = defaultdict(int)
    for a, s in enumerate(nfa.step):
        if s:
            groups[s[0]] |= 1 << a
    sets = list(groups)
    signature: dict[tuple, int] = {}
    of_byte = [signature.setdefault(tuple(c in s for s in sets), len(signature)) for c in range(256)]
    in_class = [[g for g, there in enumerate(flags) if there] for flags in signature]
    ends = sum(1 << a for a in final)
    told = ends
    for m in groups.values():
        told |= m

    def mask(states) -> int:
        return sum(1 << a for a in states) & told

    reach = {s[1]: mask(nfa.closure([s[1]])) for s in nfa.step if s}
    known: dict[int, int] = {0: 0}

    def after(members: int) -> int:
        if members not in known:
            out, rest = 0, members
            while rest:
                low = rest & -rest
                out |= reach[nfa.step[low.bit_length() - 1][1]]
                rest ^= low
            known[members] = out
        return known[members]

    number = {mask(start): 0}
    todo, table = list(number), []
    for now in todo:
        moved = [after(now & m) for m in groups.values()]
        row = []
        for gs in in_class:
            nxt = 0
            for g in gs:
                nxt |= moved[g]
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        table.append(row)
    return table, [frozenset(k for a, k in final.items() if s >> a & 1) for s in number], of_byte


def _minimise(table: list[list[int]], accepts: list[frozenset]) -> tuple[list[list[int]], list[frozenset]]:
    """Moore's partition refinement."""
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in accepts]
    count = len(names)
    while True:
        names = {}
        refined = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(table)]
        block = refined
        if len(names) == count:
            break
        count = len(names)
    one = {}
    for s, b in enumerate(block):
        one.setdefault(b, s)
    return [[block[t] for t in table[one[b]]] for b in range(count)], [accepts[one[b]] for b in range(count)], block[0]


def compile_rules(patterns: list[tuple[str, bool]], backwards: bool, anywhere: bool) -> Automaton:
    """One automaton for (expression, ignore case) rules.  anywhere: a match may begin after any bytes."""
    nfa = _Nfa()
    begin = nfa.new()
    final = {}
    for k, (text, ignore_case) in enumerate(patterns):
        s, e = nfa.build(_Parser(text, ignore_case).alt(), backwards)
        nfa.free[begin].append(s)
        final[e] = k
    if anywhere:
        loop = nfa.new()
        nfa.step[loop] = (ALL, begin)
        nfa.free[begin].append(loop)
    table, accepts, of_byte = _determinise(nfa, nfa.closure([begin]), final)
    table, accepts, start = _minimise(table, accepts)
    order = sorted(range(len(table)), key=lambda s: (bool(accepts[s]), s != start))
    place = {s: k for k, s in enumerate(order)}
    # the start is state 0, or the first accepting one if the empty text matches
    rows = [[place[table[s][of_byte[c]]] for c in range(256)] for s in order]
    return Automaton(rows, sum(not accepts[s] for s in order), [accepts[s] for s in order])


class Scanner:
    """All rules' leftmost-longest, non-overlapping matches; one backward pass, then one anchored run for each match."""

    def __init__(self, patterns: list[tuple[str, bool]]):
        self.all = compile_rules(patterns, backwards=True, anywhere=True)
        self.each = [compile_rules([p], backwards=False, anywhere=False) for p in patterns]
        self.dead = [self._dead(a) for a in self.each]
        self._link()

    @staticmethod
    def _dead(a: Automaton) -> int:
        """The state that cannot lead to a match, -1 if there is none."""
        return next((s for s, row in enumerate(a.rows) if s < a.first_hit and all(t == s for t in row)), -1)

    def _link(self) -> None:
        # rows hold rows: a step is one index; entry 256 is None or the set of rules that match from here
        self.linked = [[None] * 257 for _ in self.all.rows]
        for s, row in enumerate(self.all.rows):
            self.linked[s][:256] = [self.linked[t] for t in row]
            self.linked[s][256] = self.all.accepts[s] or None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "linked"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._link()

    def starts(self, data: bytes) -> list[tuple[int, frozenset]]:
        """(position, rules) wherever a match of a rule starts, from the end of the text."""
        state, found, at = self.linked[0], [], len(data)
        for c in reversed(data):
            at -= 1
            state = state[c]
            if state[256] is not None:
                found.append((at, state[256]))
        return found

    def longest(self, rule: int, data: bytes, at: int) -> int:
        a, dead = self.each[rule], self.dead[rule]
        state, end, rows, first = 0, -1, a.rows, a.first_hit
        for k in range(at, len(data)):
            state = rows[state][data[k]]
            if state == dead:
                break
            if state >= first:
                end = k + 1
        return end

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and rule."""
        upto: dict[int, int] = defaultdict(int)
        out = []
        for at, rules in reversed(self.starts(data)):
            for r in sorted(rules):
                if at >= upto[r]:
                    end = self.longest(r, data, at)
                    upto[r] = end
                    out.append((at, end, r))
        return out
