"""Cheapest edits of role and fault sequences, by a grammar of their common parts.

Every row of a conversation is a symbol. Re-Pair replaces the most frequent pair of neighbours in
all sequences by a new symbol until no pair is frequent. Each symbol has a transfer matrix: for every
state before and after its rows the least cost and, as a rope, the least edits of that cost. A rule's
matrix is the min-plus product of its two parts, so a part that many conversations share is
evaluated once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import zip_longest

import numpy as np

#: States: nothing said yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where another turn of the repaired conversation leads, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SAID = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted truncated row costs beside its edit.
UNENDED = 3
#: Symbols of rows: one that has to go, or a role (system, user, assistant, another), ended or truncated.
GONE = 0
ROLES = "sua"
SYMBOLS = 9
#: Rules of one grammar at most, and how often a pair must occur; sequences keep what is left.
RULES, LEAST_PAIRS = 512, 3

Rope = "str | tuple"
Entry = "tuple[int, Rope] | None"
Matrix = "list[Entry]"


def symbol(role: str, gone: bool, truncated: bool) -> int:
    """Symbol of a row; its role counts by the first letter."""
    if gone:
        return GONE
    place = ROLES.find(role[:1]) if role else -1
    return 1 + 2 * (place if place >= 0 else 3) + truncated


def role_of(sym: int) -> int:
    """0 system, 1 user, 2 assistant, 3 another."""
    return (sym - 1) // 2


# --- ropes -----------------------------------------------------------------------------------

#: Ropes up to this length are plain strings.
SHORT = 64


def joined(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= SHORT:
        return a + b
    return (a, b)


def leaves(rope: Rope):
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def text(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def less(a: Rope, b: Rope) -> bool:
    """Whether a comes before b in ASCII order; reads both only up to their first difference."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    for x, y in zip_longest((c for leaf in leaves(a) for c in leaf), (c for leaf in leaves(b) for c in leaf), fillvalue=""):
        if x != y:
            return x < y
    return False


# --- matrices --------------------------------------------------------------------------------


def better(one: Entry, other: Entry) -> Entry:
    """The cheaper entry, of equal ones that with the lesser edits."""
    if one is None or other is None:
        return other if one is None else one
    if one[0] != other[0]:
        return one if one[0] < other[0] else other
    return other if less(other[1], one[1]) else one


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; the least edits of a concatenation are those of its parts.

    Edits of one cost over the same rows are never the beginning of one another, since more
    inserts cost more; so their first difference decides whatever follows.
    """
    out: Matrix = [None] * 16
    for p in range(4):
        row = [(m, a[4 * p + m]) for m in range(4) if a[4 * p + m] is not None]
        for q in range(4):
            best = None
            for m, left in row:
                right = b[4 * m + q]
                if right is None:
                    continue
                cost = left[0] + right[0]
                if best is None or cost <= best[0]:
                    best = better(best, (cost, joined(left[1], right[1])))
            out[4 * p + q] = best
    return out


def inserts() -> Matrix:
    """Turns inserted in one place: none, one or two; more of them lead nowhere else."""
    out: Matrix = [None] * 16
    for p in range(4):
        state = p
        for n in range(3):
            out[4 * p + state] = better(out[4 * p + state], (COST[INSERT] * n, INSERT * n))
            state = NEXT[state]
    return out


def edits(sym: int) -> Matrix:
    """Edits of one row, without inserts."""
    out: Matrix = [None] * 16
    for p in range(4):
        out[5 * p] = (COST[DELETE], DELETE)
    if sym != GONE:
        extra = UNENDED * ((sym - 1) % 2)
        for p in range(4):
            to = NEXT[p]
            out[4 * p + to] = better(out[4 * p + to], (COST[REROLE] + extra, REROLE))
            if role_of(sym) == to - 1:
                out[4 * p + to] = better(out[4 * p + to], (COST[KEEP] + extra, KEEP))
        if role_of(sym) == 0:
            out[4 * START + SYSTEM] = (COST[KEEP] + extra, KEEP)
    return out


INSERTS = inserts()
#: Of every row: inserts before it, then its edit.
LETTERS = [product(INSERTS, edits(s)) for s in range(SYMBOLS)]
NOTHING: Matrix = [(0, "") if i % 5 == 0 else None for i in range(16)]


def chain(matrices: list[Matrix]) -> Matrix:
    """Product of matrices in order, by halves."""
    if not matrices:
        return NOTHING
    while len(matrices) > 1:
        pairs = [product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(matrices) // 2 * 2 :]
    return matrices[0]


def cheapest(whole: Matrix) -> tuple[int, str]:
    """Cost and edits of a conversation: from nothing said to nothing said or an assistant's turn."""
    ended = product(whole, INSERTS)
    cost, rope = better(ended[4 * START + START], ended[4 * START + ASSISTANT])
    return cost, text(rope)


# --- grammar ---------------------------------------------------------------------------------


@dataclass
class Grammar:
    rules: list[tuple[int, int]]
    #: The sequences after all replacements.
    rest: list[np.ndarray]

    def matrices(self) -> list[Matrix]:
        """Matrix of every sequence; rules only refer to earlier ones."""
        known = list(LETTERS)
        for left, right in self.rules:
            known.append(product(known[left], known[right]))
        return [chain([known[s] for s in sequence.tolist()]) for sequence in self.rest]


def re_pair(sequences: list[bytes], most: int = RULES, least: int = LEAST_PAIRS) -> Grammar:
    """Grammar of all sequences: the most frequent pair is replaced, from left to right, again and again."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    stops = np.cumsum(lengths + 1) - 1  # a sequence is followed by -1, which is in no pair
    line = np.full(int(lengths.sum()) + len(sequences), -1, np.int64)
    inside = np.ones(len(line), bool)
    inside[stops] = False
    line[inside] = np.frombuffer(b"".join(sequences), np.uint8)
    rules: list[tuple[int, int]] = []
    while len(rules) < most and len(line) > 1:
        width = SYMBOLS + len(rules)
        a, b = line[:-1], line[1:]
        valid = (a >= 0) & (b >= 0)
        codes = np.where(valid, a * width + b, -1)
        counts = np.bincount(codes[valid], minlength=1)
        best = int(counts.argmax())
        if counts[best] < least:
            break
        left, right = divmod(best, width)
        at = np.flatnonzero(codes == best)
        if left == right:  # of overlapping pairs in a run every second one
            starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(at - np.repeat(at[starts], np.diff(starts, append=len(at)))) % 2 == 0]
        if len(at) < least:
            break
        line[at] = width
        line = np.delete(line, at + 1)
        rules.append((left, right))
    ends = np.flatnonzero(line == -1)
    return Grammar(rules, [part[:-1] for part in np.split(line, ends + 1)[:-1]])


def replay(piece: str, symbols: bytes, state: int) -> tuple[list[tuple[int, str | None]], int]:
    """Turns that edits give: number of the row, or -1 for an inserted turn, and its new role (None: its own); and the state after them."""
    turns: list[tuple[int, str | None]] = []
    row = 0
    for edit in piece:
        if edit == INSERT:
            state = NEXT[state]
            turns.append((-1, SAID[state]))
            continue
        if edit == REROLE:
            state = NEXT[state]
            turns.append((row, SAID[state]))
        elif edit == KEEP:
            state = SYSTEM if role_of(symbols[row]) == 0 else NEXT[state]
            turns.append((row, None))
        row += 1
    return turns, state


def cut(audit: str, lengths: list[int]) -> list[str]:
    """The edits of consecutive slices of so many rows; inserts go with the row after them, the last ones with the last slice."""
    pieces, at = [], 0
    for n in lengths:
        start = at
        while n:
            n -= audit[at] != INSERT
            at += 1
        pieces.append(audit[start:at])
    if pieces:
        pieces[-1] += audit[at:]
    return pieces
