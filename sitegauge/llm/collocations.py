"""Phrases that occur more often than their parts suggest, by multikey three-way quicksort.

Every word is a pointer to the words that follow it in its piece, five at most. Leading words, one
and two, are first routed over the cluster by 40 bits of hash; those with fewer pointers than the
least count are abandoned before any words are sorted. A task then combines equal pointers and packs
them in blocks by the route of their two leading words. Blocks go to their routes over the cluster; a
task sorts what it gets by multikey three-way quicksort down to the last word. The size of a partition of equal
words is the count of that phrase, and a partition below the least count is abandoned together with
all its longer phrases. A route that holds a large share of all pointers is routed by one word more,
as often as needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import in_batches, slices, written

#: What ends a piece and what parts words; A-Z are lower-cased.
PIECE_ENDS, GAPS = ".,;:!?\n\v\f\r", " \t"
UNKNOWN = "und"
LONGEST = 5
#: Words that a task sorts at once, and phrases of whole routes, unless one route has more.
CHUNK, SORTED = 1_500_000, 250_000
#: Routes of a language; raise the number with the cluster. A route with over ``CROWDED`` times its
#: share of all pointers is routed by one more word, so less than a ``CROWDED``-th of them are.
ROUTES, CROWDED = 1024, 4
#: Bits of the hash of leading words, of the places in the map of frequent ones, which the driver
#: gets (4 MB), and of the rows in which hashes are sent.
HASH_BITS, MAP_BITS, ROW_BITS = 40, 25, 12
LOW_BITS = HASH_BITS - ROW_BITS
#: Hashes of one row that a task merges at once.
PENDING = 2_000_000
#: Odd factors of the hash of a pair, from the golden ratio and two square roots.
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xB504F333F9DE6485, 0xDDB3D742C265539D))
#: A byte that no UTF-8 text holds: the end of a piece.
BREAK = b"\xff"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS.encode(), b"abcdefghijklmnopqrstuvwxyz " + BREAK * len(PIECE_ENDS)
)
#: Phrases of a language and route with their counts, one a line. Of ``exact`` blocks all phrases have
#: ``k`` words; of the others the first ``k`` are the leading ones, and longer phrases are counted too.
BLOCKS = "lang string, k int, exact boolean, route int, total long, phrases string, counts array<int>"
KEY = ("lang", "k", "exact", "route")
COUNTED = "lang string, phrase string, n_words int, f long"


# --- multikey three-way quicksort ------------------------------------------------------------


def three_way(
    words: list[np.ndarray], weights: np.ndarray, ptr: np.ndarray, sizes: np.ndarray, least: int
) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Partitions of equal words below given partitions.

    ``words[d][p]`` is the word at depth d of pointer p, -1 where it has ended. ``ptr`` lists the
    pointers partition by partition, ``sizes`` says how many each has. All partitions of a depth
    are split at once, each around the word of one of its pointers: the lesser and the greater
    pointers are partitions of the same depth again, the equal ones go to the next. Yields (depth,
    ended, one pointer of each partition, weights). Partitions of less weight than ``least`` are abandoned.
    """
    draw = np.random.default_rng(len(ptr))

    def pick(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pointers of a mask, the sizes of their partitions and their weights, without abandoned ones."""
        kept = ptr[mask]
        counts = np.add.reduceat(mask, starts, dtype=np.int64)
        filled = counts > 0
        counts = counts[filled]
        sums = np.add.reduceat(weights[kept], np.cumsum(counts) - counts) if len(counts) else counts
        enough = sums >= least
        if not enough.all():
            kept = kept[np.repeat(enough, counts)]
            counts, sums = counts[enough], sums[enough]
        return kept, counts, sums

    for depth, word in enumerate(words):
        equal: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ptr):
            starts = np.cumsum(sizes) - sizes
            value = word[ptr]
            around = np.repeat(value[starts + (draw.random(len(sizes)) * sizes).astype(np.int64)], sizes)
            same, lesser = value == around, value < around
            kept, counts, sums = pick(same, starts)
            first = kept[np.cumsum(counts) - counts]
            ended = word[first] < 0
            if ended.any():
                yield depth, True, first[ended], sums[ended]
                kept, counts, first, sums = kept[np.repeat(~ended, counts)], counts[~ended], first[~ended], sums[~ended]
            if len(first):
                yield depth, False, first, sums
                equal.append((kept, counts))
            rest = [pick(lesser, starts)[:2], pick(~(same | lesser), starts)[:2]]
            ptr, sizes = np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest])
        if not equal:
            return
        ptr, sizes = np.concatenate([e[0] for e in equal]), np.concatenate([e[1] for e in equal])


# --- words and blocks ------------------------------------------------------------------------


def _batches(table: pa.Table | pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, table.num_rows, rows):
        part = table.slice(at, rows)
        yield part if isinstance(part, pa.RecordBatch) else part.combine_chunks().to_batches()[0]


def _pack(names: pa.Array, lang: np.ndarray, k: int, exact: bool, route: np.ndarray, phrases: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
    """Blocks of phrases by language (a place in ``names``) and route."""
    keys = lang * (1 << 32) + route
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    first, n = order[starts], len(starts)
    weights = weights[order]
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(lang[first])), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, exact)), pa.array(route[first].astype(np.int32)),
            pa.array(np.add.reduceat(weights, starts) if n else np.zeros(0, np.int64)),
            pc.binary_join(pa.ListArray.from_arrays(offsets, phrases.take(pa.array(order))), "\n"),
            pa.ListArray.from_arrays(offsets, pa.array(weights.astype(np.int32))),
        ],
        ["lang", "k", "exact", "route", "total", "phrases", "counts"],
    )


def _phrases(vocabulary: pa.Array, words: list[np.ndarray]) -> pa.Array:
    """Phrases of word ids; -1 stands after the last word."""
    spaced = pc.binary_join_element_wise(*[_taken(vocabulary, w) for w in words], " ", null_handling="replace", null_replacement="")
    return pc.ascii_rtrim(spaced, characters=" ")


def _combined(words: list[np.ndarray], weights: np.ndarray, ptr: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pointer of equal ones, and the sum of their weights."""
    parts = [(one, n) for depth, ended, one, n in three_way(words, weights, ptr, sizes, 1) if ended or depth == len(words) - 1]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _taken(vocabulary: pa.Array, ids: np.ndarray) -> pa.Array:
    """Words of ids, null for -1."""
    return vocabulary.take(pa.array(np.maximum(ids, 0), mask=ids < 0))


class Words:
    """Words of texts in order: language, id, and the pairs with the word after in the same piece."""

    def __init__(self, held: list[tuple[int, pa.DictionaryArray]], langs: list[str]) -> None:
        encoded = pa.chunked_array([w for _, w in held]).combine_chunks()
        self.lang = np.concatenate([np.full(len(w), k, np.int64) for k, w in held])
        self.langs = langs
        self.ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw = encoded.dictionary.to_pylist()
        stop = raw.index(BREAK)
        raw[stop] = b""
        self.ids[self.ids == stop] = -1
        self.vocabulary = pa.array(raw, pa.binary()).cast(pa.string())
        self.is_word = self.ids >= 0
        self.pairs = self.is_word[:-1] & self.is_word[1:] & (self.lang[:-1] == self.lang[1:])
        own = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))[self.ids]
        of_lang = np.fromiter((zlib.crc32(x.encode()) for x in langs), np.uint64, len(langs))[self.lang] * FACTORS[2]
        self.word_hash = (own * FACTORS[0] + of_lang) >> np.uint64(64 - HASH_BITS)
        self.pair_hash = (own[:-1] * FACTORS[0] + own[1:] * FACTORS[1] + of_lang[:-1] + FACTORS[1]) >> np.uint64(64 - HASH_BITS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of the texts of a task, some at a time."""
    held, langs, n = [], {}, 0
    for whole in batches:
        for batch in slices(iter([whole]), "text"):
            texts: dict[str, list[bytes]] = {}
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    texts.setdefault(name, []).append(text)
            for name, own in texts.items():
                marked = (BREAK.join(own) + BREAK).translate(_TABLE).replace(BREAK, b" " + BREAK + b" ")
                words = pa.array(marked.split(), pa.binary()).dictionary_encode()
                held.append((langs.setdefault(name, len(langs)), words))
                n += len(words)
            if n >= CHUNK:
                yield Words(held, list(langs))
                held, langs, n = [], {}, 0
    if n:
        yield Words(held, list(langs))


def _routed(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of a task's words and pairs with their counts, in rows by the leading bits; counts stop at ``least``."""
    small = np.min_scalar_type(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches):
            hashes = np.concatenate([words.word_hash[words.is_word], words.pair_hash[words.pairs]])
            found, counts = np.unique(hashes, return_counts=True)
            low = (found & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32)
            counts = np.minimum(counts, least).astype(small)
            ends = np.searchsorted(found, np.arange(1, (1 << ROW_BITS) + 1, dtype=np.uint64) << np.uint64(LOW_BITS))
            starts = np.append(0, ends[:-1])
            rows = np.flatnonzero(ends > starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(starts[rows], ends[rows])], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(starts[rows], ends[rows])], pa.binary()),
                ],
                ["row", "hashes", "counts"],
            )

    return work


def _frequent(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every row, in order and from all tasks, its part of the map: one bit for all hashes of a place, set by a frequent one."""
    small = np.min_scalar_type(least)
    places = 1 << (MAP_BITS - ROW_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, hashes, counts, size = None, [], [], 0

        def merge() -> None:
            nonlocal hashes, counts, size
            if hashes:
                found, at = np.unique(np.concatenate(hashes), return_inverse=True)
                sums = np.minimum(np.bincount(at, weights=np.concatenate(counts)), least)
                hashes, counts, size = [found], [sums], 0

        def done() -> pa.RecordBatch:
            merge()
            bits = np.zeros(places, bool)
            bits[hashes[0][counts[0] >= least] >> np.uint32(HASH_BITS - MAP_BITS)] = True
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["row", "bits"])

        for batch in batches:
            for at, some, n in zip(batch.column("row").to_pylist(), batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if row is not None and at != row:
                    yield done()
                    hashes, counts, size = [], [], 0
                row = at
                hashes.append(np.frombuffer(some, np.uint32))
                counts.append(np.frombuffer(n, small).astype(np.float64))
                size += len(hashes[-1])
                if size > PENDING:
                    merge()
        if row is not None:
            yield done()

    return work


def _suffix_blocks(chunk: Words, often: np.ndarray, routes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of words and of phrases by two leading words, without abandoned ones; and the words of each language (k = 0)."""
    size = len(chunk.vocabulary)
    names = pa.array(chunk.langs, pa.string())
    every, none = np.arange(len(names)), np.zeros(len(names), np.int64)
    totals = np.bincount(chunk.lang[chunk.is_word], minlength=len(names))
    yield _pack(names, every, 0, True, none, pa.array([""] * len(names), pa.string()), totals)
    place = np.uint64(HASH_BITS - MAP_BITS)
    single = np.flatnonzero(chunk.is_word & often[chunk.word_hash >> place])
    found, first, counts = np.unique(chunk.lang[single] * size + chunk.ids[single], return_index=True, return_counts=True)
    route = (chunk.word_hash[single[first]] % np.uint64(routes)).astype(np.int64)
    yield from _batches(_pack(names, found // size, 1, True, route, chunk.vocabulary.take(pa.array(found % size)), counts))

    paired = chunk.pairs & often[chunk.pair_hash >> place]
    ptr = np.flatnonzero(paired)
    if not len(ptr):
        return
    # From here on only the words of these pointers: a phrase goes on while its last two words are a pair.
    words, going, last = [chunk.ids[ptr], chunk.ids[ptr + 1]], np.ones(len(ptr), bool), len(paired)
    for k in range(1, LONGEST - 1):
        at = np.minimum(ptr + k, last - 1)
        going = going & (ptr + k < last) & paired[at]
        words.append(np.where(going, chunk.ids[np.minimum(at + 1, last)], -1))
    lang = chunk.lang[ptr]
    keys = (lang * size + words[0]) * size + words[1]
    order = np.argsort(keys, kind="stable")
    sizes = np.diff(np.append(np.flatnonzero(np.diff(keys[order], prepend=-1)), len(order)))
    one, weights = _combined(words[2:], np.ones(len(ptr), np.int64), order, sizes)
    route = (chunk.pair_hash[ptr[one]] % np.uint64(routes)).astype(np.int64)
    yield from _batches(_pack(names, lang[one], 2, False, route, _phrases(chunk.vocabulary, [w[one] for w in words]), weights))


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], pa.Array, np.ndarray]:
    """Of all phrases of blocks: block, words as ids (-1 after the last), vocabulary, and counts."""
    lines = pc.split_pattern(batch.column("phrases"), "\n")
    sizes = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = pc.split_pattern(lines.flatten(), " ")
    n = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = cut.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n) - n
    words = []
    for k in range(int(n.max()) if len(n) else 0):
        word = np.full(len(n), -1, np.int64)
        there = n > k
        word[there] = codes[starts[there] + k]
        words.append(word)
    weights = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), words, encoded.dictionary, weights


def _deeper(k: int, routes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of crowded routes by one leading word more; the phrases of ``k`` words, counted in the block, keep their route."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "phrases"):
                block, words, vocabulary, weights = _read(batch)
                names, size, keys = batch.column("lang"), len(vocabulary), block
                for word in words[:k]:
                    keys = np.unique(keys * size + word, return_inverse=True)[1]
                _, first = np.unique(keys, return_index=True)
                sums = np.bincount(keys, weights=weights).astype(np.int64)
                route = batch.column("route").to_numpy(zero_copy_only=False).astype(np.int64)
                yield from _batches(_pack(names, block[first], k, True, route[block[first]], _phrases(vocabulary, [w[first] for w in words[:k]]), sums))
                longer = np.flatnonzero(words[k] >= 0) if len(words) > k else np.zeros(0, np.int64)
                if not len(longer):
                    continue
                keys = np.unique(keys[longer] * size + words[k][longer], return_inverse=True)[1]
                _, first = np.unique(keys, return_index=True)
                leading = _phrases(vocabulary, [w[longer[first]] for w in words[: k + 1]])
                own = np.fromiter((zlib.crc32(x) for x in leading.cast(pa.binary()).to_pylist()), np.int64, len(leading)) % routes
                yield from _batches(_pack(names, block[longer], k + 1, False, own[keys], _phrases(vocabulary, [w[longer] for w in words]), weights[longer]))

    return work


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where another block key begins, in sorted rows."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for name in KEY:
        column = batch.column(name)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return new


def _counted(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of whole routes."""
    group = np.cumsum(_starts(batch)) - 1
    block, words, vocabulary, weights = _read(batch)
    sizes = np.unique(group[block], return_counts=True)[1]
    shortest, exact = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "exact"))
    for depth, ended, one, sums in three_way(words, weights, np.arange(len(weights)), sizes, least):
        if ended:
            continue
        k = shortest[block[one]]
        one, sums = (x[(depth + 1 == k) | (~exact[block[one]] & (depth + 1 > k))] for x in (one, sums))
        if len(one):
            phrases = _phrases(vocabulary, [w[one] for w in words[: depth + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(block[one])), phrases, pa.array(np.full(len(one), depth + 1, np.int32)), pa.array(sums)],
                ["lang", "phrase", "n_words", "f"])


def _by_routes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Whole routes of a sorted batch, of at most ``most`` phrases together or one route."""
    starts = np.flatnonzero(_starts(batch)) if batch.num_rows else np.zeros(0, np.int64)
    before = np.append(0, np.cumsum(pc.list_value_length(batch.column("counts")).to_numpy(zero_copy_only=False), dtype=np.int64))
    ends = np.append(starts[1:], batch.num_rows)
    at = 0
    while at < batch.num_rows:
        first = np.searchsorted(ends, at, side="right")
        last = max(first, np.searchsorted(before[ends], before[at] + most, side="right") - 1)
        yield batch.slice(at, ends[last] - at)
        at = int(ends[last])


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One block of several with one key: equal phrases are one."""
    _, words, vocabulary, weights = _read(batch)
    one, sums = _combined(words, weights, np.arange(len(weights)), np.array([len(weights)]))
    zero = np.zeros(len(one), np.int64)
    k, exact, route = (batch.column(c)[0].as_py() for c in KEY[1:])
    return _pack(batch.column("lang").slice(0, 1), zero, k, exact, zero + route, _phrases(vocabulary, [w[one] for w in words]), sums)


def _sorted_counts(blocks: DataFrame, least: int, chunk: int) -> DataFrame:
    """Frequent phrases of all routes, each route in one task, which merges its blocks ``chunk`` phrases at a time."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, chunk

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, most
            whole, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
            end = whole.num_rows if last else int(np.flatnonzero(_starts(whole))[-1])  # the last route may go on
            for part in _by_routes(whole.slice(0, end), SORTED):
                yield from _counted(part, least)
            # Batches that follow are joined to it: Spark's columns may be known to hold no nulls, its own are not.
            held = [_merged(whole.slice(end)).cast(whole.schema)] if end < whole.num_rows else []
            size = sum(len(b.column("counts").flatten()) for b in held)
            most = max(chunk, 2 * size)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("counts").flatten())
            if size >= most:
                yield from ready(False)
        if held:
            yield from ready(True)

    return in_batches(blocks.repartition(*KEY).sortWithinPartitions(*KEY), work, COUNTED)


# --- operators -------------------------------------------------------------------------------


def frequent_phrases(
    docs: DataFrame, least: int, text_column: str = "text", lang_column: str = "lang", routes: int = ROUTES, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to five words that occur at least ``least`` times, and the words of every language.

    The first frame has lang, phrase, n_words and f, the second lang and n (all its words). Texts
    are cut into pieces at line ends and ``. , ; : ! ?`` and these into words at spaces and tabs; A-Z
    are lower-cased. Overlapping occurrences count. A null text is empty, a null language ``und``.
    Other columns are not read; no rows give no rows. What is abandoned by hash changes only the
    work: leading words of at least ``least`` occurrences never are.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_column}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_column}`").alias("text"))
    rows = in_batches(texts, _routed(least), "row int, hashes binary, counts binary").repartition("row").sortWithinPartitions("row")
    often = np.zeros((1 << ROW_BITS, 1 << (MAP_BITS - ROW_BITS - 3)), np.uint8)
    for row in in_batches(rows, _frequent(least), "row int, bits binary").collect():
        often[row["row"]] = np.frombuffer(row["bits"], np.uint8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(often.reshape(-1)).astype(bool)
        for words in _words(batches):
            yield from _suffix_blocks(words, wanted, routes)

    blocks = written(in_batches(texts, cut, BLOCKS))
    languages = blocks.where("k = 0").groupBy("lang").agg(F.sum("total").alias("n"))
    share = (languages.agg(F.sum("n")).first()[0] or 0) * CROWDED // routes
    done, level = blocks.where("k = 1"), blocks.where("k = 2")
    for k in range(2, LONGEST):
        # Each holds more than a share of all pointers, so there are less than routes / CROWDED of them.
        sizes = level.groupBy("lang", "route").agg(F.sum("total").alias("n")).where(F.col("n") > share)
        crowded = [f"{r['route']}\n{r['lang']}" for r in sizes.collect()]
        if not crowded:
            break
        is_crowded = F.concat_ws("\n", F.col("route").cast("string"), "lang").isin(crowded)
        split = written(in_batches(level.where(is_crowded), _deeper(k, routes), BLOCKS))
        done = done.unionByName(level.where(~is_crowded)).unionByName(split.where("exact"))
        level = split.where("NOT exact")
    return written(_sorted_counts(done.unionByName(level), least, chunk)), languages


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(phrases: DataFrame, languages: DataFrame, least: int, top: int, absorbed: int = 100, scale: int = 1000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to five words with at least ``least`` occurrences is scored by its weakest cut:
    with l and r the occurrences of the words before and after, ``scale * a * n / (l * r)``, rounded down; ties go to
    the earlier cut. Phrases that stand inside a longer one of at least ``absorbed`` per cent of
    their occurrences are left out. Ties of score go by occurrences, then by the phrase. Products are
    decimals of 38 digits.
    """
    wide = "decimal(38,0)"
    words = F.split("phrase", " ")
    candidates = phrases.where((F.col("n_words") > 1) & (F.col("f") >= least)).select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"))

    places = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("n_words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("n_words") - k + 1), lambda i: _joined(F.col("words"), i, k))))
    inside = candidates.where("n_words > 2").select("lang", F.explode(F.array_distinct(places)).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast(wide) * F.col("longer") < F.lit(absorbed).cast(wide) * F.col("a")))

    cuts = kept.select("lang", "phrase", "n_words", "a", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _joined(F.col("words"), F.lit(1), F.col("cut")).alias("left"),
        _joined(F.col("words"), F.col("cut") + 1, F.col("n_words") - F.col("cut")).alias("right"))
    lefts = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    sized = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(languages, "lang")
    score = F.expr(f"(CAST({scale} AS decimal(5,0)) * CAST(a AS decimal(16,0)) * CAST(n AS decimal(16,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    weakest = sized.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    best = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "w.l", "w.r", "n", "w.score")
