"""Words of a lower-casing word-end BPE tokenizer, cut by a finite-state machine over whole batches.

The tokenizer normalises (NFC, lower case by character), drops white space and cuts a text into
English contractions, runs of letters, single digits and runs of other characters. The machine
below marks where words start. It reads all texts of a batch as one array: every block of
characters is run from all its states at once, which gives a map of states; the maps are composed
by a parallel prefix scan, and a second run from the then known states emits the marks.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex

BLOCK = 128
#: Letters that end a contraction alone, and pairs that do.
SINGLE, PAIRS = "stmd", ("re", "ve", "ll")
#: Input classes of the machine.
SPACE, DIGIT, OTHER, QUOTE, LETTER, ENDING, R, V, L, E = range(10)
#: States: outside a word, in letters, after a digit, in other characters, after a quote that
#: starts a word, after that and r, v or l, and after a contraction.
OUT, LETTERS, NUMBER, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, SHORT = range(9)
STATES, CLASSES = 9, 10
#: Marks: a word starts at this character, or at the one before it.
HERE, BEFORE = 1, 2
SPACES = "\t\n\v\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def _is_letter(c: int) -> bool:
    return c >= LETTER


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks."""
    late = 0
    if state == QUOTED:
        if c == ENDING:
            return SHORT, 0
        if c in (R, V, L):
            return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
        state = OTHERS
    elif state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if c == (L if state == QUOTED_L else E):
            return SHORT, 0
        state, late = LETTERS, BEFORE  # no contraction: the letter was the start of a word
    if c == SPACE:
        return OUT, late
    if c == DIGIT:
        return NUMBER, late | HERE
    if _is_letter(c):
        return LETTERS, late | (0 if state == LETTERS else HERE)
    if state == OTHERS:
        return OTHERS, late
    return (QUOTED if c == QUOTE else OTHERS), late | HERE


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by state and class. States count in steps of the number of classes."""
    both = [_step(s, c) for s in range(STATES) for c in range(CLASSES)]
    return np.array([x[0] * CLASSES for x in both], np.uint8), np.array([x[1] for x in both], np.uint8)


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
        for m in regex.finditer(pattern, every):
            shift = 0x800 if m.start() >= 0xD800 else 0
            table[m.start() + shift : m.end() + shift] = value
    for text, value in ((SPACES, SPACE), ("'", QUOTE), (SINGLE, ENDING), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in text]] = value
    return table


def normalise(text: str) -> str:
    """NFC and lower case character by character (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def scan(kinds: np.ndarray) -> np.ndarray:
    """Marks of every character of the array of classes."""
    step, mark = machine()
    n = len(kinds)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    maps = np.repeat(np.arange(0, STATES * CLASSES, CLASSES, dtype=np.uint8)[:, None], blocks, axis=1)
    for column in columns:  # every block from every state
        maps = step.take(maps + column)
    maps //= np.uint8(CLASSES)
    reach = 1
    while reach < blocks:  # compose: after this round a map covers twice as many blocks
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], axis=0)
        reach *= 2
    state = np.concatenate([[OUT], maps[OUT, :-1]]).astype(np.uint8) * np.uint8(CLASSES)
    marks = np.empty((BLOCK, blocks), np.uint8)
    for i, column in enumerate(columns):
        at = state + column
        marks[i] = mark.take(at)
        state = step.take(at)
    flat = marks.T.reshape(-1)
    starts = (flat[:n] & HERE).astype(bool)
    starts[: n - 1] |= (flat[1:n] & BEFORE).astype(bool)
    return starts


class Words:
    """Words of a list of texts as byte spans of one buffer.

    ``data`` holds the UTF-8 bytes of the normalised texts, ``start`` and ``length`` the words in
    it, ``text`` the number of the text that each word is in.
    """

    def __init__(self, texts: list[str]) -> None:
        normal = [normalise(t) for t in texts]
        joined = "\n".join(normal) + "\n"  # white space ends every state, so texts stay apart
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes()[points]
        starts = scan(kinds)
        inside = kinds != SPACE
        ends = inside.copy()  # a word ends where the next character is white space or a start
        ends[:-1] &= ~inside[1:] | starts[1:]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        self.data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(self.data) == len(points):
            self.start, stop = first, last + 1
        else:
            widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            offsets = np.concatenate([[0], np.cumsum(widths)])
            self.start, stop = offsets[first], offsets[last + 1]
        self.length = stop - self.start
        bounds = np.cumsum([len(t) + 1 for t in normal])
        self.text = np.searchsorted(bounds, first, side="right")
        self.texts = len(texts)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of one occurrence of each distinct word, and each word's number among them."""
        return groups(self.data, self.start, self.length)

    def spelt(self, index: np.ndarray) -> list[bytes]:
        """Bytes of some words."""
        data = self.data.tobytes()
        return [data[s : s + n] for s, n in zip(self.start[index].tolist(), self.length[index].tolist(), strict=True)]


#: Odd factor of the polynomial code of a word, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Powers that a worker keeps for the next batch: those of a slice.
KEPT_POWERS = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the factor and of its inverse; kept for the next batch unless a text is longer than a slice."""
    def up_to(size: int) -> list[np.ndarray]:
        return [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64))]) for f in (FACTOR, INVERSE)]

    if n > KEPT_POWERS:
        return tuple(up_to(n))
    if not _POWERS:
        _POWERS[:] = up_to(KEPT_POWERS)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def codes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit code of each span of the bytes: a polynomial read off prefix sums, mixed with the length.

    Different spans may share a code (there are known pairs for every factor): see :func:`groups`.
    """
    powers, inverse = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    code = (sums[start + length] - sums[start]) * inverse[start]
    code ^= code >> np.uint64(29)
    return code * np.uint64(0xBF58476D1CE4E5B9) ^ (length.astype(np.uint64) << np.uint64(40))


def groups(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one span of each content, and each span's number among them.

    Spans are grouped by code and then compared byte by byte with the first of their group; those
    that differ are grouped by their content.
    """
    _, index, number = np.unique(codes(data, start, length), return_index=True, return_inverse=True)
    first = index[number]
    same = length == length[first]
    check = np.flatnonzero(same & (np.arange(len(start)) != first))
    if len(check):
        n = length[check]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - n, n)
        differs = data[np.repeat(start[check], n) + step] != data[np.repeat(start[first[check]], n) + step]
        if differs.any():
            same[check[np.searchsorted(ends, np.flatnonzero(differs), side="right")]] = False
    odd = np.flatnonzero(~same)
    if len(odd):
        known: dict[bytes, int] = {}
        added, number = [], number.copy()
        for i in odd.tolist():
            content = data[start[i] : start[i] + length[i]].tobytes()
            if content not in known:
                known[content] = len(index) + len(known)
                added.append(i)
            number[i] = known[content]
        index = np.concatenate([index, np.array(added, index.dtype)])
    return index, number
