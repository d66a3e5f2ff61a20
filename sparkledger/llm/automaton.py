"""Regular expressions over bytes to automata: syntax, subset construction, minimisation.

The syntax has literals, escapes (``\\xHH`` or any escaped byte), classes with
ranges, groups, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``.
"""

from __future__ import annotations

from collections import defaultdict


class Nfa:
    """Fragments joined by empty moves; a state has moves (byte set, target) and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def add(self, tree, backward: bool = False) -> tuple[int, int]:
        """First and last state of a parsed expression, read from its end if backward."""
        kind = tree[0]
        a, b = self.state(), self.state()
        if kind == "set":
            self.moves[a].append((tree[1], b))
        elif kind == "seq":
            at = a
            for part in reversed(tree[1]) if backward else tree[1]:
                first, last = self.add(part, backward)
                self.empty[at].append(first)
                at = last
            self.empty[at].append(b)
        elif kind == "alt":
            for part in tree[1]:
                first, last = self.add(part, backward)
                self.empty[a].append(first)
                self.empty[last].append(b)
        else:
            _, part, least, unbounded = tree
            at = a
            for _ in range(least):
                first, last = self.add(part, backward)
                self.empty[at].append(first)
                at = last
            if unbounded is None:  # optional
                first, last = self.add(part, backward)
                self.empty[at] += [first, b]
                self.empty[last].append(b)
            elif unbounded:
                first, last = self.add(part, backward)
                self.empty[at] += [first, b]
                self.empty[last] += [first, b]
            else:
                self.empty[at].append(b)
        return a, b


def parse(text: str, fold: bool = False):
    """Syntax tree; fold: letters stand for either case."""
    pos = 0

    def one() -> int:
        nonlocal pos
        c = text[pos]
        pos += 1
        if c == "\\":
            c = text[pos]
            pos += 1
            if c == "x":
                pos += 2
                return int(text[pos - 2 : pos], 16)
        return ord(c)

    def either(values) -> frozenset[int]:
        out = set(values)
        if fold:
            out |= {ord(chr(v).swapcase()) for v in values if v < 128 and chr(v).isalpha()}
        return frozenset(out)

    def atom():
        nonlocal pos
        if text[pos] == "(":
            pos += 1
            tree = alternatives()
            pos += 1
            return tree
        if text[pos] == "[":
            pos += 1
            negated = text[pos] == "^"
            pos += negated
            values: set[int] = set()
            while text[pos] != "]":
                low = one()
                if text[pos] == "-" and text[pos + 1] != "]":
                    pos += 1
                    values |= set(range(low, one() + 1))
                else:
                    values.add(low)
            pos += 1
            return ("set", frozenset(range(256)) - either(values) if negated else either(values))
        return ("set", either([one()]))

    def sequence():
        nonlocal pos
        parts = []
        while pos < len(text) and text[pos] not in "|)":
            tree = atom()
            while pos < len(text) and text[pos] in "?*+{":
                c = text[pos]
                pos += 1
                if c == "{":
                    end = text.index("}", pos)
                    low, comma, _ = text[pos:end].partition(",")
                    pos = end + 1
                    tree = ("rep", tree, int(low), bool(comma))
                else:
                    tree = ("rep", tree, int(c == "+"), None if c == "?" else True)
            parts.append(tree)
        return ("seq", parts)

    def alternatives():
        nonlocal pos
        parts = [sequence()]
        while pos < len(text) and text[pos] == "|":
            pos += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return alternatives()


class Dfa:
    """Complete automaton: ``table[state << 8 | byte]`` is the next state shifted by 8; states from ``first_accepting`` on accept."""

    def __init__(self, trees: list, search: bool, backward: bool = False):
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for rule, tree in enumerate(trees):
            first, last = nfa.add(tree, backward)
            nfa.empty[start].append(first)
            ends[last] = rule
        self._minimise(*self._subsets(nfa, start, ends, search))

    @staticmethod
    def _subsets(nfa: Nfa, start: int, ends: dict[int, int], search: bool):
        """Subset construction; search: a match may begin at every byte."""
        begin = nfa.closure([start])
        number, todo, rows, accepts = {begin: 0}, [begin], [], []
        cache: dict[frozenset[int], frozenset[int]] = {}
        while todo:
            states = todo.pop(0)
            by_byte: dict[int, set[int]] = defaultdict(set)
            for s in states:
                for values, t in nfa.moves[s]:
                    for v in values:
                        by_byte[v].add(t)
            row = []
            for v in range(256):
                raw = frozenset(by_byte.get(v, ()))
                target = cache.get(raw)
                if target is None:
                    target = cache[raw] = nfa.closure(raw | {start} if search else raw)
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                row.append(number[target])
            rows.append(row)
            accepts.append(frozenset(ends[s] for s in states if s in ends))
        return rows, accepts

    def _minimise(self, rows: list[list[int]], accepts: list[frozenset[int]]) -> None:
        """Merge states that no input tells apart: refine classes until they stay."""
        names: dict = {}
        part = [names.setdefault(a, len(names)) for a in accepts]
        while True:
            names = {}
            new = [names.setdefault((part[s], tuple(part[t] for t in rows[s])), len(names)) for s in range(len(rows))]
            if len(set(new)) == len(set(part)):
                break
            part = new
        one = {}
        for s, p in enumerate(part):
            one.setdefault(p, s)
        order = sorted(one, key=lambda p: bool(accepts[one[p]]))
        place = {p: i for i, p in enumerate(order)}
        self.n_states = len(order)
        self.first_accepting = sum(not accepts[one[p]] for p in order)
        self.accepts = [sorted(accepts[one[p]]) for p in order]
        self.table = [place[part[t]] << 8 for p in order for t in rows[one[p]]]
        self.start = place[part[0]] << 8
        dead = [i for i in range(self.n_states) if i < self.first_accepting and all(t == i << 8 for t in self.table[i << 8 : (i + 1) << 8])]
        self.dead = dead[0] << 8 if dead else -1
