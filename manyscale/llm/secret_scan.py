"""Secrets in texts, by one automaton for all rules.

The rules' expressions are read into positions, joined, and turned into a deterministic automaton by subset
construction over classes of bytes; partition refinement then merges states that behave alike. Scanning a text is
one table step per byte for all rules together. Where a rule is met, a reversed automaton of that rule finds the
leftmost start and a forward one the longest end; both look only at the bytes of the match.

Matches of a rule are leftmost, longest and do not overlap; the search goes on behind a match even if it is dropped.
This equals a backtracking search for rules whose matches cannot contain a shorter one that ends before they do,
as holds for all rules here. Spans count code points.

Defined results: a null or empty text has no spans; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import DataFrame

from manyscale.llm import common

#: The rules of the contract, in its order: name, expression, and the least length of what must be long.
BASE_RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]{8,}", 32),
]
#: Lengths are tested behind a match where a counted repeat would multiply the automaton's states.
#: Rules beyond the contract: private key headers, signed web tokens, tokens of code hosts and of chat services.
MORE_RULES = [
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    ("code_host", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
]
#: The least length of the value that an assignment gives.
VALUE_LENGTH = 8


class Nfa:
    """Positions linked by byte sets and by free steps."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def add(self, items, start: int, backward: bool, fold: bool = False) -> int:
        """Append what ``items`` (a parsed expression) match behind ``start``; returns the last state."""
        for op, value in reversed(list(items)) if backward else items:
            if op in (kind.LITERAL, kind.IN, kind.ANY):
                end = self.state()
                self.steps[start].append((members(op, value, fold), end))
            elif op is kind.SUBPATTERN:
                _, added, _, inner = value
                end = self.add(inner, start, backward, fold or bool(added & 2))
            elif op is kind.BRANCH:
                end = self.state()
                for branch in value[1]:
                    first = self.state()
                    self.free[start].append(first)
                    self.free[self.add(branch, first, backward, fold)].append(end)
            elif op is kind.MAX_REPEAT:
                least, most, inner = value
                end = start
                for _ in range(least):
                    end = self.add(inner, end, backward, fold)
                if most is kind.MAXREPEAT:
                    loop = self.state()
                    self.free[end].append(loop)
                    self.free[self.add(inner, loop, backward, fold)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.free[end].append(out)
                        end = self.add(inner, end, backward, fold)
                    self.free[end].append(out)
                    end = out
            else:
                raise ValueError(f"rules cannot use {op}")
            start = end
        return start

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
        return frozenset(seen)


def members(op, value, fold: bool) -> frozenset:
    """The bytes of one character of an expression."""
    if op is kind.LITERAL:
        found = {value}
    elif op is kind.ANY:
        found = set(range(256)) - {10}
    else:
        negated, found = value[0][0] is kind.NEGATE, set()
        for part, what in value[1:] if negated else value:
            found.update({what} if part is kind.LITERAL else range(what[0], what[1] + 1))
        if negated:
            found = set(range(256)) - found
    if fold:
        found |= {ord(swapped) for b in found if b < 128 and (swapped := chr(b).swapcase()).isascii()}
    return frozenset(found)


class Automaton:
    """A minimal deterministic automaton over byte classes. ``table[state][class]`` is the next state."""

    def __init__(self, expressions: list[str], anywhere: bool, backward: bool = False):
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for number, expression in enumerate(expressions):
            first = nfa.state()
            nfa.free[start].append(first)
            ends[nfa.add(parser.parse(expression), first, backward)] = number
        # Bytes that no rule tells apart share a class.
        sets = sorted({s for steps in nfa.steps for s, _ in steps}, key=sorted)
        marks = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {mark: k for k, mark in enumerate(dict.fromkeys(marks))}
        self.classes = bytes(kinds[mark] for mark in marks)
        sample = [self.classes.index(k) for k in range(len(kinds))]
        origin = nfa.closure([start])
        states, table, todo = {origin: 0}, [], [origin]
        while todo:
            current, row = todo.pop(0), []
            for byte in sample:
                reached = {t for s in current for allowed, t in nfa.steps[s] if byte in allowed}
                target = nfa.closure(reached | ({start} if anywhere else set()))
                if target not in states:
                    states[target] = len(states)
                    todo.append(target)
                row.append(states[target])
            table.append(row)
        accepts = [tuple(sorted(ends[s] for s in members_of if s in ends)) for members_of in states]
        self.table, self.accepts = minimal(table, accepts)

    def longest(self, data, at: int, stop: int, step: int) -> int:
        """How many bytes the longest match from ``at`` has, walking towards ``stop``; 0 if there is none."""
        state, found, first = 0, 0, at
        while at != stop:
            state = self.table[state][self.classes[data[at]]]
            at += step
            if self.accepts[state]:
                found = abs(at - first)
            elif all(t == state for t in self.table[state]):
                break
        return found


def minimal(table: list[list[int]], accepts: list[tuple]) -> tuple[list[list[int]], list[tuple]]:
    """The same automaton with states merged that accept and lead on alike; the start stays state 0."""
    numbers = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
    group = [numbers[a] for a in accepts]
    while True:
        keys = [(group[s], *(group[t] for t in row)) for s, row in enumerate(table)]
        numbers = {key: k for k, key in enumerate(dict.fromkeys(keys))}
        finer = [numbers[key] for key in keys]
        if len(numbers) == len(set(group)):
            break
        group = finer
    first = {}
    for state, g in enumerate(finer):
        first.setdefault(g, state)
    return [[finer[t] for t in table[first[g]]] for g in range(len(first))], [accepts[first[g]] for g in range(len(first))]


class Scanner:
    """All rules in one automaton, and the two automata of each rule for the bounds of a match."""

    def __init__(self, rules: tuple[tuple[str, str, int], ...], automata: list[Automaton]):
        together, self.forward, self.backward = automata[0], automata[1::2], automata[2::2]
        self.rules = rules
        self.classes = bytes(c + 1 for c in together.classes)
        # A row's first entry says which rules are met; the others are the rows of the next states.
        self.rows = [[met or None] for met in together.accepts]
        for row, targets in zip(self.rows, together.table):
            row.extend(self.rows[t] for t in targets)

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` of every match, in bytes."""
        behind, found = [0] * len(self.rules), []
        row = self.rows[0]
        for at, c in enumerate(data.translate(self.classes), 1):
            row = row[c]
            if row[0]:
                for rule in row[0]:
                    if at <= behind[rule]:
                        continue
                    size = self.backward[rule].longest(data, at - 1, behind[rule] - 1, -1)
                    if size:
                        start = at - size
                        behind[rule] = end = start + self.forward[rule].longest(data, start, len(data), 1)
                        found.append((start, rule, end))
        return sorted(found)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points, by start, then rule."""
        data = text.encode()
        kept = [(s, rule, e) for s, rule, e in self.matches(data) if self.long_enough(data, s, rule, e)]
        if len(text) == len(data):
            return [(self.rules[rule][0], s, e) for s, rule, e in kept]
        place, last, out = 0, 0, []
        for s, rule, e in kept:
            place += len(data[last:s].decode())
            last = s
            out.append((self.rules[rule][0], place, place + len(data[s:e].decode())))
        return out

    def long_enough(self, data: bytes, start: int, rule: int, end: int) -> bool:
        name, _, least = self.rules[rule]
        if name == "assign":
            return value_length(data[start:end]) >= VALUE_LENGTH
        return end - start >= least


def value_length(match: bytes) -> int:
    """The length of what an assignment gives: what follows the first separator, blanks and a quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    while match[at:at + 1] == b" ":
        at += 1
    return len(match) - at - (match[at:at + 1] in (b'"', b"'"))


@lru_cache(maxsize=4)
def compiled(rules: tuple) -> list[Automaton]:
    """The automaton of all rules, then a forward and a backward one for each."""
    alone = [Automaton([expression], anywhere=False, backward=b) for _, expression, _ in rules for b in (False, True)]
    return [Automaton([expression for _, expression, _ in rules], anywhere=True), *alone]


_scanners: dict[tuple, Scanner] = {}


def scanner(rules: tuple, automata: list[Automaton] | None = None) -> Scanner:
    """Kept for all tasks of a Python worker."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules, automata or compiled(rules))
    return _scanners[rules]


def scan(docs: DataFrame, rules=(*BASE_RULES, *MORE_RULES), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, found array<struct<kind, start, end>>)`` of every whole text, by start, then rule.

    Documents stay in their partitions; the tables, about a MB for a dozen rules, are made once and broadcast.
    """
    rules = tuple(map(tuple, rules))
    sent = docs.sparkSession.sparkContext.broadcast(compiled(rules))

    def work(ids, texts):
        known = scanner(rules, sent.value)
        return {"doc_id": ids, "found": [[{"kind": k, "start": s, "end": e} for k, s, e in known.spans(t)] if t else [] for t in texts]}

    return common.on_texts(docs, work, "doc_id long, found array<struct<kind: string, start: long, end: long>>", id, text)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
