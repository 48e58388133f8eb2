"""Token counts by a tokenizer that is compiled to finite-state transducers.

Two machines run one after the other. The first (``words``) cuts texts into words; the second
reads a word byte by byte and emits, on every transition, by how much the number of tokens grows.
Neither builds a token list.

Why the second is finite. In byte-pair encoding, a sequence of tokens is the encoding of its text
exactly if each two neighbours are the encoding of theirs, so every prefix of a word has one last
token t: the token ending there that agrees with the last token before it. The next byte can only
extend tokens that began at positions from which the bytes read so far still spell the start of
some token. A state is therefore the list of these open positions: where in the trie of tokens
they stand, the last token before them, and their count relative to the current one. States and
transitions are made when first needed and kept by the Python worker; equal lists are one state.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import by_slices, texts_of
from sitegauge.llm.words import Words

#: Cells of the transition table that a worker keeps, 5 bytes each; beyond these the machine is
#: compiled anew from what follows.
MOST_CELLS = 24_000_000
#: Symbols: a byte, and a byte that ends the word.
SYMBOLS = 512
LAST = 256
#: Order of a token that no merge makes.
SINGLE = -1


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Machine:
    """Transducer of the words of a BPE vocabulary with word ends."""

    def __init__(self, path: str, most_cells: int = MOST_CELLS) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end, letters = model["end_of_word_suffix"], byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            body = token.removesuffix(end)
            spelt = [letters[c] for c in body]
            return (*spelt[:-1], spelt[-1] + (LAST if body != token else 0))

        self.spelling = {i: symbols(t) for t, i in model["vocab"].items()}
        of = {s: i for i, s in self.spelling.items()}
        # Merges by their two tokens, and for each token the order and the parts of its own merge.
        self.ranks: dict[tuple[int, int], int] = {}
        self.order = dict.fromkeys(self.spelling, SINGLE)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for rank, (x, y) in enumerate(model["merges"]):
            left, right = model["vocab"][x], model["vocab"][y]
            token = of[self.spelling[left] + self.spelling[right]]
            self.ranks[left, right] = rank
            if self.order[token] == SINGLE:
                self.order[token], self.left[token], self.right[token] = rank, left, right
        # Trie of tokens: for each node its children, and the token that ends there or -1.
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for s, i in of.items():
            node = 0
            for c in s:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][c]
            self.token[node] = i
        self.is_whole: dict[int, bool] = {}
        self.most_cells = most_cells
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first, and the columns of the symbols."""
        self.lists = [((0, -1, 0),)]
        self.number = {self.lists[0]: 0}
        self.column = np.full(SYMBOLS, -1, np.int64)
        self.symbols: list[int] = []
        self.next, self.grown = np.full((1024, 64), -1, np.int32), np.zeros((1024, 64), np.int8)

    def resize(self, rows: int, columns: int) -> None:
        """Room for so many states and symbols."""
        (r, c), n, g = self.next.shape, self.next, self.grown
        self.next, self.grown = np.full((rows, columns), -1, np.int32), np.zeros((rows, columns), np.int8)
        self.next[:r, :c], self.grown[:r, :c] = n, g

    def agree(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: the start of the word).

        The merges inside both are undone, latest first. If the two tokens that then touch at the
        border have a merge that would have come before the one just undone, they would have been
        merged across the border.
        """
        if before < 0:
            return self.order[token] == SINGLE or self.whole(token)
        limit = len(self.ranks) + 1
        while True:
            across = self.ranks.get((before, token))
            if across is not None and across < limit:
                return False
            if self.order[before] > self.order[token]:
                limit = self.order[before]
                before = self.right[before]
            elif self.order[token] != SINGLE:
                limit = self.order[token] + 1
                token = self.left[token]
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own spelling: its parts are, and agree."""
        if token not in self.is_whole:
            left, right = self.left[token], self.right[token]
            # Both parts must be what merging gives before the merge that joins them.
            self.is_whole[token] = all(self.order[x] == SINGLE or self.whole(x) for x in (left, right)) and self.first_across(left, right)
        return self.is_whole[token]

    def first_across(self, left: int, right: int) -> bool:
        """Whether nothing is merged across the border before the two parts are whole."""
        rank, self.ranks[left, right] = self.ranks[left, right], len(self.ranks) + 2
        try:
            return self.agree(left, right)
        finally:
            self.ranks[left, right] = rank

    def compile(self, state: int, symbol: int) -> None:
        """Make one transition."""
        moved = [(self.children[node].get(symbol, -1), before, count) for node, before, count in self.lists[state]]
        moved = [x for x in moved if x[0] >= 0]
        token, grown = next((self.token[node], count + 1) for node, before, count in moved if self.token[node] >= 0 and self.agree(before, self.token[node]))
        after = 0
        if symbol < LAST:
            open_ = tuple(sorted([(node, before, count - grown) for node, before, count in moved if self.children[node]] + [(0, token, 0)]))
            if open_ not in self.number:
                self.number[open_] = len(self.lists)
                self.lists.append(open_)
                if len(self.lists) > len(self.next):
                    self.resize(len(self.next) * 3 // 2, self.next.shape[1])
            after = self.number[open_]
        self.next[state, self.column[symbol]] = after
        self.grown[state, self.column[symbol]] = grown

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word; all words step through the machine together, longest first."""
        if self.next.size > self.most_cells:
            self.clear()
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        tokens, state = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for i, n in enumerate(alive):
            symbol = data[start[:n] + i].astype(np.int64)
            symbol[length[:n] == i + 1] += LAST
            column = self.column[symbol]
            if column.min() < 0:
                for x in np.unique(symbol[column < 0]).tolist():
                    self.column[x] = len(self.symbols)
                    self.symbols.append(x)
                if len(self.symbols) > self.next.shape[1]:
                    self.resize(len(self.next), len(self.symbols) + 31)
                column = self.column[symbol]
            at = state[:n] * self.next.shape[1] + column
            missing = np.unique(at[self.next.reshape(-1)[at] < 0])
            width = self.next.shape[1]
            for x in missing.tolist():
                self.compile(x // width, self.symbols[x % width])
            state[:n] = self.next.reshape(-1)[at]
            tokens[:n] += self.grown.reshape(-1)[at]
        out = np.empty_like(tokens)
        out[order] = tokens
        return out


@functools.lru_cache(2)
def machine(path: str) -> Machine:
    """The worker's machine, kept between batches and tasks."""
    return Machine(path)


@functools.lru_cache(2)
def special_strings(path: str) -> re.Pattern | None:
    """Strings that the tokenizer takes as one token wherever they occur in a text."""
    with open(path, encoding="utf-8") as file:
        found = [x["content"] for x in json.load(file)["added_tokens"]]
    return re.compile("|".join(re.escape(x) for x in sorted(found, key=len, reverse=True))) if found else None


def counts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of every text. A special string counts one and separates what stands around it."""
    special = special_strings(path)
    parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = special.split(text) if special else [text]
        extra[i] = len(pieces) - 1
        parts += pieces
        owner += [i] * len(pieces)
    words = Words(parts)
    index, number = words.distinct()
    each = machine(path).count(words.data, words.start[index], words.length[index])
    of_text = np.asarray(owner, np.int64)[words.text] if parts else words.text
    return extra + np.bincount(of_text, weights=each[number], minlength=len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with the size of its whole text: doc_id, n_bytes, n_tokens, over_limit (above ``limit``).

    Null texts count as empty: no bytes, no tokens. Rows, repeated ones and null ids included, are
    taken one by one without a shuffle; other columns, whatever their names, are not read; an
    empty table gives no rows. ``path`` is a word-end BPE tokenizer in JSON form, which every
    executor must have.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
        n = counts(texts_of(batch, "text"), path)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return by_slices(rows, "text", work, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
