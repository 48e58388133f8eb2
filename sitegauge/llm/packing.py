"""Best-fit decreasing packing of tokenized documents into sequences of fixed capacity."""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm.common import by_slices, cut, numbered, texts_of
from sitegauge.llm.token_counts import special_strings
from sitegauge.llm.words import Words

#: Bytes of words that a worker remembers with their ids before it starts anew.
MOST_WORD_BYTES = 4_000_000
#: Buckets that number the pieces of one length.
RANK_BUCKETS = 256


class Vocabulary:
    """Ids of words by the tokenizer library, remembered by the words themselves."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_strings(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are not known yet."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        begin = len(self.flat) + np.cumsum(size) - size
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.flat = np.concatenate([self.flat, flat])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it.

        Words are encoded apart, as the tokenizer does after cutting a text into them; a text with
        a special string goes to the tokenizer whole.
        """
        whole = {i for i, t in enumerate(texts) if self.special and self.special.search(t)}
        words = Words(["" if i in whole else t for i, t in enumerate(texts)])
        index, number = words.distinct()
        if self.held > MOST_WORD_BYTES:
            self.clear()
        spelt = words.spelt(index)
        if new := [w for w in spelt if w not in self.known]:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, spelt), np.int64, len(spelt))[number]
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.searchsorted(words.text, np.arange(len(texts)), side="right")]
        if whole:
            parts = np.split(flat, upto[:-1])
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            flat, upto = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return flat, upto


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary, kept between batches and tasks."""
    return Vocabulary(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of every tokenized text: doc_id, piece, start, length, ids_crc32.

    A text's ids, then ``separator``, are cut into pieces of ``capacity`` where they are longer;
    the last piece may be shorter. ids_crc32 is over the ids as little-endian 32-bit numbers.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch, "text")
        flat, upto = vocabulary(path).ids(texts)
        ended = np.insert(flat, upto, np.uint32(separator)).astype("<u4")
        stop = upto + np.arange(1, len(texts) + 1)
        size = np.diff(stop, prepend=0)
        n = -(-size // capacity)
        owner = np.repeat(np.arange(len(texts)), n)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(size[owner] - start, capacity)
        begin = (stop - size)[owner] + start
        data = memoryview(ended.tobytes())
        crc = [zlib.crc32(data[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return by_slices(rows, "text", work, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


@dataclass
class OpenBins:
    """Segment tree over remaining capacities; a leaf holds ranges of bins, a node whether there are any."""

    capacity: int
    ranges: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.width = 1 << self.capacity.bit_length()
        self.some = [False] * (2 * self.width)

    def _mark(self, room: int) -> None:
        node, value = room + self.width, bool(self.ranges.get(room))
        while node and self.some[node] != value:
            self.some[node] = value
            node //= 2
            if node:
                value = self.some[2 * node] or self.some[2 * node + 1]

    def add(self, room: int, first: int, bins: int) -> None:
        """Bins ``first`` to ``first + bins - 1`` have ``room`` left."""
        if room:
            self.ranges.setdefault(room, []).append((first, bins))
            self._mark(room)

    def tightest(self, length: int) -> int | None:
        """Least remaining capacity of at least ``length`` that a bin has."""
        node = length + self.width
        if self.some[node]:
            return length
        while node > 1:  # up to the first right neighbour with bins, then down its left edge
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins with exactly this room, which leave it."""
        first, bins = self.ranges[room].pop()
        if bins > most:
            self.ranges[room].append((first + most, bins - most))
            bins = most
        self._mark(room)
        return first, bins


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows ``(length, from, to, sequence, per_sequence, offset)``: of the pieces of this length, those
    ranked ``from`` to ``to - 1`` go to sequences from ``sequence`` on, ``per_sequence`` to each,
    the first at ``offset``. Pieces are taken longest first, each to the open sequence with the
    least room that holds it; equal pieces fill one sequence after the other, so whole ranges are
    placed in one step of logarithmic time. The result is that of placing pieces one by one, while the work
    depends on the number of different lengths, which the capacity bounds, and not on the rows.
    """
    bins, plan, opened = OpenBins(capacity), [], 0
    for length in sorted(lengths, reverse=True):
        done, count = 0, lengths[length]
        while done < count:
            room = bins.tightest(length)
            each = (room or capacity) // length  # once used, a sequence is the tightest until it is too full
            wanted = -(-(count - done) // each)
            if room is None:
                room, first, n = capacity, opened, wanted
                opened += n
            else:
                first, n = bins.take(room, wanted)
            upto = min(count, done + n * each)
            full, rest = divmod(upto - done, each)
            plan.append((length, done, upto, first, each, capacity - room))
            bins.add(room - each * length, first, full)
            if rest:
                bins.add(room - rest * length, first + full, 1)
            done = upto
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Rows of ``token_pieces`` with sequence_id and offset, packed best-fit decreasing.

    The driver sees a histogram with at most ``capacity`` rows and makes the plan; Spark ranks the
    pieces of every length, in buckets, so that no length is gathered in one task, and looks up
    their places. The broadcast plan is bounded by the capacity, not by the rows.
    """
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    names = ["length", "from_rank", "to_rank", "first_sequence", "per_sequence", "first_offset"]
    columns = zip(*best_fit(lengths, capacity), strict=True) if lengths else [()] * len(names)
    # An Arrow table becomes a local relation; a list of rows would start Python workers of another kind on the executors.
    plan = pieces.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS))
    ranked = numbered(pieces, "rank", ["length"], bucket, [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")])
    p, r = ranked.alias("p"), F.broadcast(plan).alias("r")
    step = F.col("rank") - F.col("from_rank")
    return p.join(r, (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_sequence") * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All texts packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of the separator alone. Repeated rows and null ids are
    packed row by row. Other columns, whatever their names, are not read; an empty table gives no
    rows. Texts are tokenized once: the pieces, of some 40 bytes each, are checkpointed, because the
    plan needs their histogram before any piece has a place.
    """
    return pack(cut(token_pieces(docs, path, capacity, separator, id_column, text_column)), capacity)
