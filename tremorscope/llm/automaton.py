"""Regular expressions over bytes as minimal transition arrays, and one automaton that runs many of them at once.

Patterns may hold literals, ``[...]``, ``(...)``, ``(?i:...)``, ``|`` and the
repeats ``? * + {n} {n,} {n,m}``. Matches are leftmost and as long as possible,
and don't overlap within a rule.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np

ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: Bytes a lane takes in one go, and the lanes under which bytes are taken singly.
LANE, FEW_LANES = 1024, 6


class _Parser:
    """A pattern to a nested tuple: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self, ahead: int = 1) -> str:
        return self.text[self.at : self.at + ahead]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self, fold: bool = False):
        parts = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(fold))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom(fold)))
        return ("cat", parts)

    def repeated(self, part):
        while (sign := self.peek()) and sign in "?*+{":
            self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                least, _, most = self.text[self.at : end].partition(",")
                bounds = (int(least), (int(most) if most else None) if "," in self.text[self.at : end] else int(least))
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            part = ("rep", part, *bounds)
        return part

    def atom(self, fold: bool):
        sign = self.take()
        if sign == "(":
            if self.peek(3) == "?i:":
                self.at, fold = self.at + 3, True
            inner = self.choice(fold)
            if self.peek() != ")":
                raise ValueError(f"{self.text!r}: a group isn't closed")
            self.take()
            return inner
        if sign == "[":
            return self._set(self.members(), fold)
        return self._set([self.escaped(sign)], fold)

    def escaped(self, sign: str) -> str:
        if sign != "\\":
            return sign
        sign = self.take()
        if sign == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        return ESCAPES.get(sign, sign)

    def members(self) -> list[str]:
        out = []
        while self.peek() != "]":
            low = self.escaped(self.take())
            if self.peek() == "-" and self.peek(2) != "-]":
                self.take()
                out += [chr(c) for c in range(ord(low), ord(self.escaped(self.take())) + 1)]
            else:
                out.append(low)
        self.take()
        return out

    def _set(self, members: list[str], fold: bool):
        if any(ord(c) > 127 for c in members):
            raise ValueError(f"{self.text!r}: only ASCII can be matched")
        both = {x for c in members for x in ((c.lower(), c.upper()) if fold else (c,))}
        return ("set", frozenset(map(ord, both)))


def parsed(pattern: str):
    parser = _Parser(pattern)
    tree = parser.choice()
    if parser.at < len(pattern):
        raise ValueError(f"{pattern!r}: can't read from {parser.at}")
    return tree


def backwards(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [backwards(p) for p in reversed(tree[1])])
    if kind == "or":
        return ("or", [backwards(p) for p in tree[1]])
    return ("rep", backwards(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Moves:
    """A nondeterministic automaton: edges by byte set, and empty edges."""

    def __init__(self, tree):
        self.edges, self.empty = [], []
        self.first, self.last = self.add(tree)

    def node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree) -> tuple[int, int]:
        kind, a, b = tree[0], self.node(), self.node()
        if kind == "set":
            self.edges[a].append((tree[1], b))
        elif kind == "or":
            for part in tree[1]:
                x, y = self.add(part)
                self.empty[a].append(x)
                self.empty[y].append(b)
        else:
            parts = tree[1] if kind == "cat" else [tree[1]] * (tree[2] if tree[3] is None else tree[3])
            at = a
            for i, part in enumerate(parts):
                if kind == "rep" and i >= tree[2]:
                    self.empty[at].append(b)
                x, y = self.add(part)
                self.empty[at].append(x)
                at = y
            if kind == "rep" and tree[3] is None:
                x, y = self.add(tree[1])
                loop = self.node()
                self.empty[at].append(loop)
                self.empty[loop] += [x, b]
                self.empty[y].append(loop)
            else:
                self.empty[at].append(b)
        return a, b

    def closed(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def minimal(moves: np.ndarray, mark: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest automaton with the same marks along every input, its start as state 0: blocks are split until all states of one move alike."""
    block = np.unique(mark, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, one = np.unique(block, return_index=True)
    order = np.argsort(np.where(one == one[block[start]], -1, one), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[block[moves[one[order]]]], mark[one[order]]


def deterministic(tree) -> tuple[np.ndarray, np.ndarray]:
    """(moves by state and byte, accepting) by subset construction and minimisation; state 0 is the start."""
    net = _Moves(tree)
    found, rows, queue = {}, [], [net.closed([net.first])]
    found[queue[0]] = 0
    for nodes in queue:
        targets: dict[int, set[int]] = {}
        for n in nodes:
            for members, to in net.edges[n]:
                for byte in members:
                    targets.setdefault(byte, set()).add(to)
        row = {}
        for byte, to in targets.items():
            reached = net.closed(to)
            if reached not in found:
                found[reached] = len(queue)
                queue.append(reached)
            row[byte] = found[reached]
        rows.append(row)
    dead = len(queue)
    moves = np.full((dead + 1, 256), dead)
    for i, row in enumerate(rows):
        for byte, to in row.items():
            moves[i, byte] = to
    return minimal(moves, np.array([net.last in nodes for nodes in queue] + [False]), 0)


class Combined:
    """All patterns in one automaton: ``ends`` finds the ends of their matches in one pass over the bytes.

    A state is, for each rule, the list of its unfinished matches by start;
    once the first of them accepts, later ones lie inside it and go. A rule is
    refused with ValueError unless its matches have two bytes or more, go on
    accepting until they end, and never finish behind an earlier open one: then
    a match ends just where its rule's mark goes out.
    """

    def __init__(self, patterns: list[str]):
        if len(patterns) > 16:
            raise ValueError("16 rules at most")
        trees = [parsed(p) for p in patterns]
        self.patterns, self.reversed = patterns, [deterministic(backwards(t)) for t in trees]
        single = [deterministic(t) for t in trees]
        dead = [self._dead(moves, accepting) for moves, accepting in single]
        for pattern, (moves, accepting), none in zip(patterns, single, dead, strict=True):
            on = moves[accepting]
            if accepting[0] or accepting[moves[0]].any() or not (accepting[on] | (on == none)).all():
                raise ValueError(f"{pattern!r}: matches must have two bytes or more and stay matches as they grow")
        columns = np.vstack([moves for moves, _ in single])
        _, sample, self.kind = np.unique(columns, axis=1, return_index=True, return_inverse=True)
        self.kind = self.kind.reshape(-1).astype(np.uint8)

        def step(rule: int, threads: tuple[int, ...], byte: int) -> tuple[int, ...]:
            moves, accepting = single[rule]
            out: list[int] = []
            for to in [int(moves[s, byte]) for s in (*threads, 0)]:
                if to != dead[rule] and to not in out:
                    if accepting[to]:
                        if out:
                            raise ValueError(f"{patterns[rule]!r}: a match may finish behind an earlier open one")
                        return (to,)
                    out.append(to)
            return tuple(out)

        start = ((),) * len(patterns)
        found, queue, rows, known = {start: 0}, [start], [], {}
        for state in queue:
            row = []
            for byte in sample:
                reached = []
                for rule, threads in enumerate(state):
                    key = (rule, threads, int(byte))
                    if key not in known:
                        known[key] = step(*key)
                    reached.append(known[key])
                reached = tuple(reached)
                if reached not in found:
                    found[reached] = len(queue)
                    queue.append(reached)
                row.append(found[reached])
            rows.append(row)
        mark = np.array([sum(1 << r for r, threads in enumerate(state) if threads and single[r][1][threads[0]]) for state in queue], dtype=np.uint16)
        moves, self.mark = minimal(np.array(rows), mark, 0)
        self.n_states, self.n_kinds = moves.shape
        self.flat = (moves * self.n_kinds).astype(np.int32).reshape(-1)  # a state stands for its row's place
        self.marks = np.repeat(self.mark, self.n_kinds)
        self.resets = (moves == 0).all(axis=0)

    @staticmethod
    def _dead(moves: np.ndarray, accepting: np.ndarray) -> int:
        stuck = np.flatnonzero((moves == np.arange(len(moves))[:, None]).all(axis=1) & ~accepting)
        return int(stuck[0]) if len(stuck) else -1

    def resets_on(self, byte: int) -> bool:
        """Whether no match holds ``byte``: every state moves to the start."""
        return bool(self.resets[self.kind[byte]])

    def marked(self, data: bytes) -> np.ndarray:
        """For each byte, the rules (bits) that have a match up to and with it.

        Lanes are cut after bytes that reset every state, so each may start
        anew, and run side by side, a byte each a step; what is left of few
        long lanes runs byte by byte.
        """
        kinds = self.kind[np.frombuffer(data, dtype=np.uint8)]
        n, out = len(kinds), np.zeros(len(kinds), dtype=np.uint16)
        safe = np.flatnonzero(self.resets[kinds]) + 1
        cuts = safe[np.minimum(np.searchsorted(safe, np.arange(LANE, n, LANE)), max(len(safe) - 1, 0))] if len(safe) else safe
        starts = np.unique(np.concatenate([[0], cuts[cuts < n]])).astype(np.int64)
        lengths = np.diff(np.append(starts, n))
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")  # lanes with so many bytes or more
        state, done = np.zeros(len(at), dtype=np.int32), 0
        for k in active.tolist():
            if k <= FEW_LANES:
                break
            where = at[:k] + done
            state = self.flat.take(state[:k] + kinds.take(where))
            out[where] = self.marks.take(state)
            done += 1
        flat = self.flat.tolist() if (lengths > done).any() else []
        for lane in np.flatnonzero(lengths > done):
            low, high = int(at[lane]) + done, int(at[lane] + lengths[lane])
            rest = accumulate(kinds[low:high].tobytes(), lambda s, c: flat[s + c], initial=int(state[lane]))
            out[low:high] = self.marks.take(np.fromiter(rest, dtype=np.int32, count=high - low + 1)[1:])
        return out

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of all matches, by end."""
        if not data:
            return []
        marks = self.marked(data)
        gone = marks & ~np.append(marks[1:], np.uint16(0))
        last, out = [0] * len(self.patterns), []
        for at in np.flatnonzero(gone).tolist():
            for rule in range(len(self.patterns)):
                if int(gone[at]) >> rule & 1:
                    out.append((rule, self._start(rule, data, last[rule], at + 1), at + 1))
                    last[rule] = at + 1
        return out

    def _start(self, rule: int, data: bytes, low: int, end: int) -> int:
        """The leftmost start from ``low`` of a match up to ``end``, by the reversed rule."""
        moves, accepting = self.reversed[rule]
        dead, state, best = self._dead(moves, accepting), 0, end
        for at in range(end - 1, low - 1, -1):
            state = int(moves[state, data[at]])
            if state == dead:
                break
            if accepting[state]:
                best = at
        return best
