"""Secrets in texts, found by one automaton for all rules.

A rule is a regular expression (``head``) followed by as many characters of a class (``tail``) as there are. The
rules are compiled together: expressions become a nondeterministic automaton, its subset construction is minimised, and
what remains are arrays, a class for each byte and a next state for each state and class. Texts are read once, byte
by byte, against that table. To keep numpy busy a block of texts is cut into lanes that advance in step; a lane ends
behind a byte that no rule can use, so no match crosses two lanes and every lane begins in the start state. Where the
automaton has accepted in a lane, the lane's matches are taken from left to right with the rule's own head automaton.

Matches of a rule are leftmost and do not overlap: the longest match of its head, then the tail as far as it goes. A
match with fewer than ``least`` characters in its tail uses up its characters but is no finding. Places are code points,
the end is exclusive.

Defined cases: a null or empty text has no findings; texts of any length are read whole; repeated rows and rows
without an id are scanned like any other; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
LANE_BYTES = 512
# Fewer lanes than this are followed one by one; steps of numpy do not pay any more.
FEW_LANES = 48
MAX_STATES = 20_000
# Between two texts; occurs in no UTF-8.
_GAP = 0xFF

SPANS_SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"


@dataclass(frozen=True)
class Rule:
    """``first``: characters of the tail without which there is no match at all; ``least``: for a match to be a finding."""

    kind: str
    head: str
    tail: str = ""
    first: int = 1
    least: int = 1
    either_case: bool = False


# The first three rules are those that every scan has; runs of digits shorter than the least are no match.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 1, 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 1, 16),
    Rule("hex", "", "[0-9a-f]", 24, 24),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("host_token", "gh[oprsu]_", "[A-Za-z0-9]", 1, 36),
    Rule("chat_token", "xox[abprs]-", "[A-Za-z0-9-]", 1, 10),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 1, 8),
    Rule("cloud_key", "AIza", "[A-Za-z0-9_-]", 1, 35),
)
RULES = BASE_RULES + MORE_RULES


class _Reader:
    """A regular expression as a tree of ("set", bytes), ("seq", parts), ("or", parts) and ("many", part, least, most).

    It knows literals, ``\\xHH`` and escaped marks, classes with ranges, groups, ``|`` and ``? * + {n} {n,} {n,m}``.
    """

    def __init__(self, text: str, either_case: bool) -> None:
        self.text, self.at, self.either_case = text, 0, either_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def read(self):
        tree = self.either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return tree

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        part = self.single()
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                self.at = end + 1
                part = ("many", part, int(least), (int(most) if most else None) if comma else int(least))
            else:
                part = ("many", part, int(mark == "+"), 1 if mark == "?" else None)
        return part

    def single(self):
        mark = self.peek()
        if mark == "(":
            self.take()
            tree = self.either()
            if self.take() != ")":
                raise ValueError(f"no ) in {self.text!r}")
            return tree
        if mark == "[":
            return self.letters()
        return self.folded({self.byte()})

    def byte(self) -> int:
        mark = self.take()
        if mark == "\\":
            mark = self.take()
            if mark == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if mark.isalnum():
                raise ValueError(f"\\{mark} is not known")
        elif mark in "*+?{.^$":
            raise ValueError(f"{mark} is not known here")
        return self._plain(mark)

    def letters(self):
        self.take()
        out: set[int] = set()
        while self.peek() != "]":
            low = self.byte() if self.peek() == "\\" else self._plain(self.take())
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.byte() if self.peek() == "\\" else self._plain(self.take())
            out.update(range(low, high + 1))
        self.take()
        return self.folded(out)

    @staticmethod
    def _plain(mark: str) -> int:
        if ord(mark) >= 0x80:
            raise ValueError("rules are written in ASCII")
        return ord(mark)

    def folded(self, chosen: set[int]):
        if self.either_case:
            chosen = chosen | {ord(chr(b).swapcase()) for b in chosen if b < 0x80 and chr(b).isalpha()}
        return ("set", frozenset(chosen))


class _Nfa:
    """States with free moves and moves on sets of bytes; built from trees."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Appends ``tree`` behind ``start`` and returns the state reached by it."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "seq":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "or":
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        self.free[start].append(end)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            after = self.add(part, loop)
            self.free[after] += [loop, end]
        else:
            for _ in range(most - least):
                start = self.add(part, start)
                self.free[start].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in seen:
                    seen.add(after)
                    todo.append(after)
        return frozenset(seen)

    def used_bytes(self) -> set[int]:
        return {b for moves in self.moves for chosen, _ in moves for b in chosen}


@dataclass(frozen=True)
class Automaton:
    """``classes``: the class of each byte; ``table[state * width + class]``: next state times width; ``marks``: rules
    that end in a state, as bits. Accepting states are the last ones, from ``accepting`` on."""

    classes: np.ndarray
    table: np.ndarray
    width: int
    start: int
    accepting: int
    marks: list[int]


def _determined(nfa: _Nfa, start: int, ends: dict[int, int], anywhere: bool) -> Automaton:
    """Subset construction, then minimisation. ``ends``: final states with their bit; ``anywhere``: a match may begin at any byte."""
    sets = {chosen for moves in nfa.moves for chosen, _ in moves}
    listed = sorted(sets, key=sorted)
    signature = [tuple(b in chosen for chosen in listed) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in kinds]
    first = nfa.closed([start])
    numbers, todo, rows = {first: 0}, [first], []
    while todo:
        here = todo.pop()
        row = []
        for byte in sample:
            reached = {after for s in here for chosen, after in nfa.moves[s] if byte in chosen}
            after = nfa.closed(reached | ({start} if anywhere else set()))
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        rows.append((numbers[here], row))
        if len(numbers) > MAX_STATES:
            raise ValueError(f"the rules need more than {MAX_STATES} states")
    steps = np.array([row for _, row in sorted(rows)])
    marks = np.array([sum({ends[s] for s in states if s in ends}) for states in numbers])
    block = np.unique(marks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[steps]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    one_of = np.zeros(count, np.int64)
    one_of[block] = np.arange(len(block))
    final = marks[one_of] > 0
    order = sorted(range(count), key=lambda b: bool(final[b]))
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    width = len(sample)
    table = np.zeros((count, width), np.int64)
    table[place] = place[block[steps[one_of]]]
    accepted = [int(marks[one_of[b]]) for b in order]
    return Automaton(classes, (table * width).ravel(), width, int(place[block[0]]) * width, int((~final).sum()), accepted)


def _tree(rule: Rule, tail: bool):
    head = _Reader(rule.head, rule.either_case).read()
    if not (tail and rule.tail):
        return head
    return ("seq", [head, ("many", _Reader(rule.tail, False).read(), rule.first, rule.first)])


class Scanner:
    """The compiled rules: the automaton over all of them, and head and tail of each."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.rules = tuple(rules)
        nfa, ends = _Nfa(), {}
        start = nfa.state()
        used: set[int] = set()
        for i, rule in enumerate(self.rules):
            ends[nfa.add(_tree(rule, tail=True), start)] = 1 << i
            if rule.tail:
                used |= _Reader(rule.tail, False).read()[1][0][1][0][1]
        used |= nfa.used_bytes()
        self.all = _determined(nfa, start, ends, anywhere=True)
        self.cut = np.array([b not in used for b in range(256)])
        self.heads, self.tails = [], []
        for rule in self.rules:
            own = _Nfa()
            begin = own.state()
            done = own.add(_tree(rule, tail=False), begin)
            self.heads.append(_determined(own, begin, {done: 1}, anywhere=False))
            taken = _Reader(rule.tail, False).read()[1][0][1][0][1] if rule.tail else frozenset()
            self.tails.append([b in taken for b in range(256)])

    def _lanes(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of lanes, each behind a byte that no rule uses."""
        cuts = np.flatnonzero(self.cut[body])
        after = np.searchsorted(cuts, np.arange(LANE_BYTES, len(body), LANE_BYTES))
        inner = np.unique(cuts[after[after < len(cuts)]]) + 1
        starts = np.concatenate([[0], inner[inner < len(body)]])
        return starts, np.append(starts[1:], len(body))

    def _accepting_lanes(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the lanes in which some rule is accepted."""
        table, floor = self.all.table, self.all.accepting * self.all.width
        seen = self.all.classes[body]
        order = np.argsort(starts - ends, kind="stable")
        at, sizes = starts[order].copy(), (ends - starts)[order]
        state, peak = np.full(len(order), self.all.start), np.zeros(len(order), np.int64)
        running = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        step = 0
        for step, n in enumerate(running.tolist()):
            if n < FEW_LANES:
                break
            np.take(table, state[:n] + seen[at[:n]], out=state[:n])
            np.maximum(peak[:n], state[:n], out=peak[:n])
            at[:n] += 1
        else:
            step = len(running)
        if step < len(running):
            steps = table.tolist()
            for lane in range(running[step]):
                here, top = int(state[lane]), int(peak[lane])
                for kind in seen[at[lane] : ends[order[lane]]].tobytes():
                    here = steps[here + kind]
                    if here > top:
                        top = here
                peak[lane] = top
        return np.sort(order[peak >= floor])

    def _rules_in(self, lane: bytes) -> int:
        """The rules accepted somewhere in a lane, as bits."""
        auto, here, bits = self.all, self.all.start, 0
        for kind in auto.classes[np.frombuffer(lane, np.uint8)].tolist():
            here = int(auto.table[here + kind])
            bits |= auto.marks[here // auto.width]
        return bits

    def _matches(self, number: int, lane: bytes) -> Iterator[tuple[int, int]]:
        rule, auto, tail = self.rules[number], self.heads[number], self.tails[number]
        classes, table, width = auto.classes.tolist(), auto.table.tolist(), auto.width
        stuck = {s * width for s in range(auto.accepting) if (auto.table[s * width : (s + 1) * width] == s * width).all()}
        at, size = 0, len(lane)
        while at < size:
            here, end, place = auto.start, at if auto.marks[auto.start // width] else -1, at
            while place < size:
                here = table[here + classes[lane[place]]]
                place += 1
                if auto.marks[here // width]:
                    end = place
                elif here in stuck:
                    break
            if end < 0:
                at += 1
                continue
            stop = end
            while stop < size and tail[lane[stop]]:
                stop += 1
            if stop == at or (rule.tail and stop - end < rule.first):
                at = max(at + 1, stop if not rule.head else at + 1)
                continue
            if not rule.tail or stop - end >= rule.least:
                yield at, stop
            at = stop

    def findings(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), in bytes, by start and then in the order of the rules."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = bytes([_GAP]).join(texts)
        body = np.frombuffer(joined, np.uint8)
        if not len(body):
            return out
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, ends = self._lanes(body)
        for lane in self._accepting_lanes(body, starts, ends).tolist():
            low, high = int(starts[lane]), int(ends[lane])
            part = joined[low:high]
            bits = self._rules_in(part)
            for number in range(len(self.rules)):
                if bits >> number & 1:
                    for start, end in self._matches(number, part):
                        doc = int(np.searchsorted(begins, low + start, "right")) - 1
                        out[doc].append((low + start - int(begins[doc]), number, low + end - int(begins[doc])))
        return [sorted(found) for found in out]


def _code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found or text.isascii():
        return found
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[start]), number, int(before[end])) for start, number, end in found]


def scan(docs: DataFrame, rules: Iterable[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: all findings by start, then in the order of the rules."""
    scanner = Scanner(rules)
    kinds = [rule.kind for rule in scanner.rules]

    def rows(names: list, texts: list[bytes]) -> pa.RecordBatch:
        spans = [
            [{"kind": kinds[number], "start": start, "end": end} for start, number, end in _code_points(text, found)]
            for text, found in zip(texts, scanner.findings(texts), strict=True)
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, size = [], [], 0
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                names.append(name)
                texts.append(value.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield rows(names, texts)
                    names, texts, size = [], [], 0
            if names:
                yield rows(names, texts)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(emit, SPANS_SCHEMA)


def of_kinds(spans: Column, kinds: Iterable[str]) -> Column:
    wanted = list(kinds)
    return F.filter(spans, lambda span: span["kind"].isin(wanted))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, parted by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
