"""Regular expressions over bytes, compiled to minimal deterministic automata.

Syntax: literals, ``\\x20`` and ``\\.`` escapes, ``[...]`` classes with ranges and ``^``, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``; ``(?i:...)`` folds ASCII case.
A tree compiles to a Thompson automaton, that by subset construction over byte classes to a
deterministic one, and partition refinement makes this minimal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = frozenset(range(256))
POSTFIX = {"?": (0, 1), "*": (0, None), "+": (1, None)}


class Parser:
    """Recursive descent to trees: ('set', bytes), ('cat', [..]), ('alt', [..]), ('rep', tree, low, high)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.alternation(False)
        if self.i != len(self.p):
            raise ValueError(f"cannot read {self.p!r} at {self.i}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternation(self, fold: bool):
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence(fold))
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self, fold: bool):
        items = []
        while self.peek() not in ("", "|", ")"):
            item = self.atom(fold)
            while self.peek() and self.peek() in "?*+{":
                low, high = self.counts()
                item = ("rep", item, low, high)
            items.append(item)
        return ("cat", items)

    def counts(self) -> tuple[int, int | None]:
        if (c := self.take()) in POSTFIX:
            return POSTFIX[c]
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i : end].partition(",")
        self.i = end + 1
        return int(low), int(high) if high else None if comma else int(low)

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.p.startswith("?i:", self.i):
                self.i += 3
                fold = True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.alternation(fold)
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return tree
        if c == "[":
            return ("set", self.members(fold))
        if c == ".":
            return ("set", ALL)
        return ("set", folded({self.escape() if c == "\\" else ord(c)}, fold))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self, fold: bool) -> frozenset[int]:
        found: set[int] = set()
        negate = self.peek() == "^"
        self.i += negate
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                found.update(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        found = folded(found, fold)
        return frozenset(ALL - found) if negate else frozenset(found)


def folded(members: set[int], fold: bool) -> frozenset[int]:
    return frozenset({ord(x) for m in members for c in [chr(m)] for x in ({c.lower(), c.upper()} if fold and m < 128 else {c})})


def reverse(tree):
    match tree:
        case ("cat", items):
            return ("cat", [reverse(x) for x in reversed(items)])
        case ("alt", items):
            return ("alt", [reverse(x) for x in items])
        case ("rep", item, low, high):
            return ("rep", reverse(item), low, high)
    return tree


@dataclass
class Thompson:
    empty: list[list[int]] = field(default_factory=list)
    steps: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        """Adds ``tree`` behind ``start``; returns its last state."""
        match tree:
            case ("set", members):
                end = self.state()
                self.steps[start].append((members, end))
            case ("cat", items):
                end = start
                for x in items:
                    end = self.build(x, end)
            case ("alt", items):
                end = self.state()
                for x in items:
                    s = self.state()
                    self.empty[start].append(s)
                    self.empty[self.build(x, s)].append(end)
            case ("rep", item, low, high):
                at = start
                for _ in range(low):
                    at = self.build(item, at)
                end = self.state()
                self.empty[at].append(end)
                if high is None:
                    loop = self.state()
                    self.empty[at].append(loop)
                    last = self.build(item, loop)
                    self.empty[last] += [loop, end]
                else:
                    for _ in range(high - low):
                        s = self.state()
                        self.empty[at].append(s)
                        at = self.build(item, s)
                        self.empty[at].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """``table[state + byte]`` is the next state; states are multiples of 256, those at or above
    ``accepting`` accept and ``rules[state]`` has a bit for each rule that does. State 0 starts, and
    ``dead`` is the state without a way out (None if there is none)."""

    table: list[int]
    accepting: int
    rules: dict[int, int]
    start: int
    dead: int | None


def compiled(trees: list, anywhere: bool) -> Dfa:
    """The minimal automaton of all ``trees`` at once; ``anywhere``: a match may start at any byte."""
    nfa = Thompson()
    start = nfa.state()
    if anywhere:
        nfa.steps[start].append((ALL, start))
    ends = {}
    for rule, tree in enumerate(trees):
        s = nfa.state()
        nfa.empty[start].append(s)
        ends[nfa.build(tree, s)] = 1 << rule
    # Bytes that no set tells apart form a class.
    sets = {m for steps in nfa.steps for m, _ in steps}
    classes: dict[tuple, list[int]] = {}
    for b in range(256):
        classes.setdefault(tuple(b in m for m in sets), []).append(b)
    groups = list(classes.values())
    # Subset construction.
    first = nfa.closure({start})
    number, todo, moves = {first: 0}, [first], []
    while todo:
        current = todo.pop(0)
        row = []
        for g in groups:
            to = nfa.closure({t for s in current for m, t in nfa.steps[s] if g[0] in m})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        moves.append(row)
    masks = [0] * len(number)
    for states, k in number.items():
        for s in states:
            masks[k] |= ends.get(s, 0)
    # Minimisation: refine the partition by accepted rules until successors agree.
    block = masks
    count = len(set(block))
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[k], *(block[t] for t in row)), len(names)) for k, row in enumerate(moves)]
        if len(names) == count:
            break
        count = len(names)
    sample = {b: k for k, b in reversed(list(enumerate(block)))}
    order = sorted(sample, key=lambda b: (masks[sample[b]] > 0, b != block[0]))
    place = {b: i * 256 for i, b in enumerate(order)}
    table = [0] * (256 * len(order))
    dead = None
    for b in order:
        row = moves[sample[b]]
        for g, t in zip(groups, row, strict=True):
            for byte in g:
                table[place[b] + byte] = place[block[t]]
        if not masks[sample[b]] and all(block[t] == b for t in row):
            dead = place[b]
    rules = {place[b]: masks[sample[b]] for b in order if masks[sample[b]]}
    return Dfa(table, min(rules, default=256 * len(order)), rules, place[block[0]], dead)


def earliest(tree):
    """A tree whose matches end where those of ``tree`` can end first: a last part that goes on and on is cut to
    its least. In the automaton of all rules such tails would multiply the states of each other."""
    if tree[0] == "cat" and tree[1]:
        return ("cat", [*tree[1][:-1], earliest(tree[1][-1])])
    if tree[0] == "rep" and tree[3] is None and tree[2]:
        return ("rep", tree[1], tree[2], tree[2])
    return tree


class Scanner:
    """Leftmost, non-overlapping, longest matches of each rule, all rules in one pass over the bytes.

    The pass runs one automaton of all rules. Where a rule first accepts, a reverse automaton walks
    back to the leftmost start (never before the rule's last end) and the rule's own automaton
    forward to the longest end.
    """

    def __init__(self, patterns: dict[str, str]):
        trees = [Parser(p).parse() for p in patterns.values()]
        self.names = list(patterns)
        self.dfa = compiled([earliest(t) for t in trees], anywhere=True)
        self.forward = [compiled([t], anywhere=False) for t in trees]
        self.backward = [compiled([reverse(t)], anywhere=False) for t in trees]

    @staticmethod
    def _longest(dfa: Dfa, data, positions, none: int) -> int:
        s, table, accepting, dead, found = dfa.start, dfa.table, dfa.accepting, dfa.dead, none
        for i in positions:
            s = table[s + data[i]]
            if s >= accepting:
                found = i
            elif s == dead:
                break
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in order."""
        table, accepting, rules = self.dfa.table, self.dfa.accepting, self.dfa.rules
        out: list[tuple[int, int, int]] = []
        done = [0] * len(self.names)
        s = self.dfa.start
        for i, b in enumerate(data):
            s = table[s + b]
            if s >= accepting:
                mask = rules[s]
                for r in range(len(done)):
                    if mask >> r & 1 and i >= done[r]:
                        start = self._longest(self.backward[r], data, range(i, done[r] - 1, -1), -1)
                        if start >= 0:
                            done[r] = self._longest(self.forward[r], data, range(start, len(data)), i) + 1
                            out.append((start, r, done[r]))
        out.sort()
        return out
