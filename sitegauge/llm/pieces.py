"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and scores are read from a model file. The best segmentation is the one of the greatest
sum of scores; characters that no piece covers fall back to byte pieces. White space is kept as
the model's marker in pieces and becomes a space again when decoding.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import by_slices, texts_of
from sitegauge.llm.words import groups

#: White space marker of the pieces.
MARKER = "▁"
#: How far an uncovered character scores below the worst piece.
PENALTY = 10.0
#: Bytes of a chunk that the array form takes; longer chunks are decoded one by one.
LONG = 256
_WIDTHS = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


class DoubleArray:
    """Trie in two arrays: the child of ``node`` by byte b is ``base[node] + b`` if its ``check`` is ``node``."""

    def __init__(self, words: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, number in words.items():
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][b]
            value[node] = number
        size = 2 * len(children) + 1024
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        taken = bytearray(size)
        taken[0] = 1
        self.check[0] = -2
        place, first = {0: 0}, 1
        for node in range(len(children)):  # parents come before their children
            at = place[node]
            self.value[at] = value[node]
            below = sorted(children[node].items())
            if not below:
                continue
            lowest, slot = below[0][0], first
            while True:
                slot = taken.index(0, max(slot, lowest))
                base = slot - lowest
                if all(not taken[base + b] for b, _ in below):
                    break
                slot += 1
            self.base[at] = base
            for b, child in below:
                taken[base + b] = 1
                self.check[base + b] = at
                place[child] = base + b
            if len(below) > 1 and slot - first > 4096:
                first += 256  # crowded region; later single children would crawl through it as well
            first = taken.index(0, first)


class Pieces:
    """Pieces of a model, with encoding and decoding of whole batches."""

    def __init__(self, path: str, scores: list[float] | None = None) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.score = np.array(scores or [model.get_score(i) for i in range(n)])
        self.byte = np.full(256, -1, np.int64)
        spelt, words = [b""] * n, {}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                spelt[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                spelt[i] = name.replace(MARKER, " ").encode()
                words[spelt[i]] = i
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        # Chunks begin where a space follows another character; that is exact if no piece crosses such a place.
        self.chunked = not any(b" " in w.lstrip(b" ") for w in words)
        self.trie = DoubleArray(words)
        self.unknown = float(min(self.score[i] for i in words.values())) - PENALTY
        self.spelt_size = np.array([len(s) for s in spelt], np.int64)
        self.spelt_begin = np.cumsum(self.spelt_size) - self.spelt_size
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def segment(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of every chunk: ids of all chunks in one array, and each chunk's number of ids.

        All chunks move through the positions together. Among equal sums the earlier start of the
        last piece wins.
        """
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        n, longest = len(start), int(length[0]) if len(start) else 0
        data = np.concatenate([data, np.zeros(4, np.uint8)])
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        piece, back = np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.int16)
        alive = np.searchsorted(-length, -np.arange(longest), side="left")
        trie, score = self.trie, self.score
        for i in range(longest):
            live = np.flatnonzero(best[i, : alive[i]] > -np.inf)
            width = _WIDTHS[data[start[live] + i]]
            single = np.zeros(len(live), bool)
            at, node, k = np.arange(len(live)), np.zeros(len(live), np.int64), i
            while True:
                at_word = live[at]
                child = trie.base[node] + data[start[at_word] + k]
                good = (length[at_word] > k) & (trie.check[child] == node)
                at, node, at_word, k = at[good], child[good], at_word[good], k + 1
                if not len(at):
                    break
                number = trie.value[node]
                hit = np.flatnonzero(number >= 0)
                single[at[hit[k - i == width[at[hit]]]]] = True
                word, found = at_word[hit], number[hit]
                total = best[i, word] + score[found]
                better = total > best[k, word]
                word = word[better]
                best[k, word], piece[k, word], back[k, word] = total[better], found[better], i
            word, to = live[~single], i + width[~single]
            total = best[i, word] + self.unknown
            better = total > best[to, word]
            word, to = word[better], to[better]
            best[to, word], piece[to, word], back[to, word] = total[better], -1, i
        # Back from the ends; an uncovered character gives its bytes, last one first.
        position, word, found = length.copy(), np.arange(n), []
        while len(word := word[position[word] > 0]):
            here, before = piece[position[word], word], back[position[word], word]
            plain = here >= 0
            found.append((word[plain], here[plain].astype(np.int64), position[word[plain]]))
            for j in range(4):
                some = word[~plain]
                place = position[some] - 1 - j
                inside = place >= before[~plain]
                some, place = some[inside], place[inside]
                found.append((some, self.byte[data[start[some] + place]], place + 1))
            position[word] = before
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
        word, ids, end = (np.concatenate(x) for x in zip(*found, strict=True))
        original = order[word]
        return ids[np.lexsort((end, original))], np.bincount(original, minlength=n)

    def segment_long(self, chunk: bytes) -> list[int]:
        """The same for one chunk of any length."""
        n, trie = len(chunk), self.trie
        best, piece, back = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            width, node, single = int(_WIDTHS[chunk[i]]), 0, False
            for k in range(i, n):
                child = int(trie.base[node]) + chunk[k]
                if trie.check[child] != node:
                    break
                node, number = child, int(trie.value[child])
                if number >= 0:
                    single |= k + 1 - i == width
                    if (total := best[i] + float(self.score[number])) > best[k + 1]:
                        best[k + 1], piece[k + 1], back[k + 1] = total, number, i
            if not single and best[i] + self.unknown > best[i + width]:
                best[i + width], piece[i + width], back[i + width] = best[i] + self.unknown, -1, i
        out, k = [], n
        while k:
            i = back[k]
            out += [piece[k]] if piece[k] >= 0 else [int(self.byte[b]) for b in reversed(chunk[i:k])]
            k = i
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it. Equal chunks are segmented once."""
        parts = [b" " + t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        begins = np.cumsum(sizes) - sizes
        opening = np.zeros(len(data) + 1, bool)
        opening[begins] = True
        if self.chunked:
            space = data == 32
            opening[1:-1] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(opening[:-1])
        length = np.diff(start, append=len(data))
        index, number = groups(data, start, length)
        short = length[index] <= LONG
        ids, n = self.segment(data, start[index][short], length[index][short])
        size = np.zeros(len(index), np.int64)
        size[short] = n
        begin = np.zeros(len(index), np.int64)
        begin[short] = np.cumsum(n) - n
        for j in np.flatnonzero(~short).tolist():
            s = int(start[index[j]])
            found = self.segment_long(data[s : s + int(length[index[j]])].tobytes())
            begin[j], size[j] = len(ids), len(found)
            ids = np.concatenate([ids, found])
        each = size[number]
        ends = np.cumsum(each)
        flat = ids[np.repeat(begin[number] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.searchsorted(start, begins + sizes, side="left")]
        return flat, upto

    def decode(self, flat: np.ndarray, upto: np.ndarray) -> list[str]:
        """Texts of the ids: spellings with the marker as a space, without the space put before a text."""
        size = self.spelt_size[flat]
        ends = np.cumsum(size)
        data = self.spelt[np.repeat(self.spelt_begin[flat] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], upto])].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(bounds, bounds[1:], strict=False)]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """The worker's pieces, kept between batches and tasks."""
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row encoded and decoded again: doc_id, ids, n_pieces, n_bytes (byte pieces), decoded_sha256, round_trip.

    A null text counts as empty and has no pieces. Whole texts are encoded, row by row without a
    shuffle; repeated rows and null ids give rows of their own. Other columns, whatever their
    names, are not read; an empty table gives no rows. A marker character inside a text is no
    white space; it falls back to bytes, so every text comes back exactly.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = pieces(path), texts_of(batch, "text")
        flat, upto = model.encode(texts)
        decoded = model.decode(flat, upto)
        bounds = np.concatenate([[0], upto])
        fallback = np.concatenate([[0], np.cumsum(np.isin(flat, model.byte))])
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array(fallback[bounds[1:]] - fallback[bounds[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
            pa.array([a == b for a, b in zip(texts, decoded, strict=True)]),
        ], ["doc_id", "ids", "n_pieces", "n_bytes", "decoded_sha256", "round_trip"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return by_slices(rows, "text", work, f"doc_id {id_type}, ids array<int>, n_pieces long, n_bytes long, decoded_sha256 string, round_trip boolean")
