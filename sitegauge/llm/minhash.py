"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is its runs of five words, each weighted by how often it occurs. ProbMinHash lets every
run arrive in a Poisson process whose rate is its weight, each arrival at a random register; a
register keeps the run that arrived first. Two texts agree in a register with the probability
Jaccard similarity of their weights. A second set of registers, with every weight 1, stands for the
plain Jaccard similarity. Registers are joined to bands; texts that share a band are compared
exactly, and those similar enough are linked into classes. Members of a bucket that one comparison
each does not settle must also share one of their rarest runs, as all similar texts do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import by_slices, discard, fresh, in_batches, release, slices, texts_of, written
from sitegauge.llm.words import groups

RUN_WORDS, SIMILAR = 5, 0.8
#: 24 bands of 5 registers in each of the two sets: of pairs at similarity 0.8 in either, one in 14,000 shares no band.
BANDS, BAND_REGISTERS = 24, 5
#: Members that one hub is compared with in one block.
BLOCK_MEMBERS = 256
#: How many times as many hubs a bucket names in each further round.
HUB_GROWTH = 64
#: Bits of the table that tells how rare a run is, and of its rows; counts in it stop at 255.
RARITY_BITS, RARITY_ROW_BITS = 22, 12
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _step(n: int) -> np.uint64:
    """The n-th multiple of the constant, modulo 2**64."""
    return np.uint64(int(_GOLDEN) * n % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: Column) -> Column:
    """Lower-cased words of a text with single spaces between them; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def node_of(words: Column) -> Column:
    """128-bit digest of the words: rows with the same words are one node."""
    return F.substring(F.sha2(words, 256), 1, 32)


def weighted_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of all texts, sorted by text and run: text number, run code, weight.

    A text of fewer words than a run has one run of them all; a text without words has none.
    """
    parts = [t.encode() + b" " if t else b"" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    stop = np.flatnonzero(data == 32)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    owner = np.searchsorted(np.cumsum([len(p) for p in parts]), start, side="right")
    index, number = groups(data, start, stop - start)
    raw = data.tobytes()
    spelt = (raw[s:e] for s, e in zip(start[index].tolist(), stop[index].tolist(), strict=True))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, spelt), np.uint64, len(index))[number]
    held = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(held) - held
    n = np.where(held > 0, np.maximum(held - RUN_WORDS + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(text))
    run = np.zeros(len(text), np.uint64)
    for i in range(RUN_WORDS):
        inside = begin + i < first[text] + held[text]
        run[inside] = mix(run[inside] + _step(i + 1) + word[begin[inside] + i])
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(new)
    return text[at], run[at], np.diff(at, append=len(text)).astype(np.float64)


def signatures(text: np.ndarray, run: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash registers of every text: the code of the run that arrived first.

    All runs of all texts advance together, one arrival each. A run stops once its next arrival is
    later than the latest first arrival of its text: no register could take it any more.
    """
    first = np.full(texts * registers, np.inf)
    held = np.zeros(texts * registers, np.uint64)
    time, number = np.zeros(len(run)), 0
    while len(run):
        number += 1
        draw = mix(run + _step(number))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        time = time - np.log(uniform) / weight
        at = text * registers + (mix(draw ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        sooner = np.flatnonzero(time < first[at])
        sooner = sooner[np.argsort(-time[sooner], kind="stable")]  # the soonest is written last
        first[at[sooner]], held[at[sooner]] = time[sooner], run[sooner]
        latest = first.reshape(texts, registers).max(axis=1)
        on = time < latest[text]
        text, run, weight, time = text[on], run[on], weight[on], time[on]
    return held.reshape(texts, registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key for each band of the registers."""
    parts = registers.reshape(len(registers), -1, BAND_REGISTERS)
    key = np.repeat(np.arange(parts.shape[1], dtype=np.uint64)[None], len(parts), axis=0)
    for i in range(BAND_REGISTERS):
        key = mix(key * _GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def band_lists(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of all texts one after the other, and where each text's end; none without words.

    A text has the bands of its weighted registers and those of its plain ones that differ. Both
    sets share their keys, so a text without repeated runs has each band once.
    """
    text, run, weight = weighted_runs(texts)
    some = np.bincount(text, minlength=len(texts)) > 0
    keys = band_keys(signatures(text, run, weight, len(texts), BANDS * BAND_REGISTERS))
    plain, repeats = keys.copy(), np.zeros(len(texts), bool)
    repeats[text[weight > 1]] = True
    if repeats.any():
        of = repeats[text]
        number = np.cumsum(repeats)[text[of]] - 1
        plain[repeats] = band_keys(signatures(number, run[of], np.ones(len(number)), int(repeats.sum()), BANDS * BAND_REGISTERS))
    taken = np.concatenate([np.ones(keys.shape, bool), plain != keys], axis=1) & some[:, None]
    return np.concatenate([keys, plain], axis=1)[taken], np.cumsum(taken.sum(axis=1))


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard similarity of the weighted runs, and plain Jaccard similarity of the runs."""
    (runs, x), (others, y) = a, b
    if not len(runs) or not len(others):
        return 0.0, 0.0
    place = np.searchsorted(others, runs).clip(0, len(others) - 1)
    both = others[place] == runs
    common = int(both.sum())
    if not common:
        return 0.0, 0.0
    p, q = x[both], y[place[both]]
    # For a common run i the sum of max(x_j / x_i, y_j / y_i) over all j; x_j wins where x_j / y_j is larger.
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    ratio = p / q
    lower = np.searchsorted(ratio, ratio, side="left")
    p_above = p.sum() - np.concatenate([[0.0], np.cumsum(p)])[lower]
    q_below = np.concatenate([[0.0], np.cumsum(q)])[lower]
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    weighted = float((1 / ((p_above + only_x) / p + (q_below + only_y) / q)).sum())
    return weighted, common / (len(runs) + len(others) - common)


def banded(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, node, bands) of every row; texts without words have no bands."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text_column}`")).alias("words"))
    rows = rows.withColumn("node", node_of(F.col("words")))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ends = band_lists(texts_of(batch, "words"))
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), bands], ["doc_id", "node", "bands"])

    return by_slices(rows, "words", work, "doc_id long, node string, bands array<long>")


def _again(column: str) -> Column:
    """The column in a form that Spark deals anew for a join, so that adaptive execution may split a hot value."""
    c = F.col(column)
    return F.concat(c, F.lit(":")) if column != "key" else c.bitwiseXOR(F.lit(-1))


def _rejoin(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """Join of frames on ``column`` that deals both sides anew."""
    right = right.withColumn("__again", _again(column)).drop(column)
    return left.withColumn("__again", _again(column)).join(right, "__again", how).drop("__again")


def compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (hub, member) with their weighted and their plain similarity, over whole texts.

    The members of a hub are dealt to blocks of about ``BLOCK_MEMBERS``, each with a copy of the
    hub's words, so a hub of very many members is no single task. The rows of a block pass one
    after the other behind their hub; nothing is gathered.
    """
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    members = _rejoin(pairs, blocks, "hub").withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    members = members.join(words.withColumnRenamed("node", "member"), "member").select("hub", "block", "member", "words")
    hubs = blocks.join(words.withColumnRenamed("node", "hub"), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("member"), "words")
    rows = members.unionByName(hubs).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("member").asc_nulls_first())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, (np.zeros(0, np.uint64), np.zeros(0))
        for batch in slices(batches, "words"):
            text, run, weight = weighted_runs(texts_of(batch, "words"))
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            found = []
            for i, (hub, member) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), strict=True)):
                these = run[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]
                if member is None:
                    current, own = hub, these
                elif hub != current:
                    raise ValueError("a block has no hub")
                else:
                    found.append((hub, member, *similarities(own, these)))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            types = (pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["hub", "member", "weighted", "plain"])
        release()

    return in_batches(rows, work, "hub string, member string, weighted double, plain double")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: each component is a star around its least node."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"))))
    nodes = edges.select(ends.alias("end")).select("end.*").groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.where("out > 1 OR out > least").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the least node of its component.

    Alternating stars: each node hands its larger, then its smaller neighbours the least node of
    its neighbourhood, until only stars are left, which no round would change. The number of rounds grows
    with the logarithm of a component's size; every round is an aggregate with partial sums and a join.
    Both directions of an edge come from one row, not from a union, which would have its whole plan twice.
    """
    def pairs(rows: DataFrame, *of: tuple[str, str]) -> DataFrame:
        return rows.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in of])).alias("edge")).select("edge.*")

    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        both = pairs(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _rejoin(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = pairs(_rejoin(large, least, "u"), ("v", "m"), ("u", "m"))
        edges, before = written(small.where("u <> v").distinct()), edges
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def split_by_hub(bands: DataFrame, words: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Labels after every bucket was compared with one hub, and the smaller buckets that remain.

    The hub is the member that shares the most with others, so that copies of one text meet its
    middle. One minus either similarity is a metric: if x is further than twice the allowed
    distance from the hub and y no further than once, x and y cannot be similar. A bucket therefore
    falls into the members not far from the hub and those not near it; pairs of a near and a far
    one need no comparison, and all others are together in one of the two. Members keep their
    similarities to the hub, by which later rounds leave out more pairs.
    """
    degree = bands.groupBy("node").agg(F.sum("n").alias("degree"))
    live = _rejoin(bands.select("key", "node"), degree, "node")
    rank = Window.partitionBy("key").orderBy(F.desc("degree"), "node")
    hubs = live.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= 1).select("key", F.col("node").alias("hub"))
    rows = written(_rejoin(bands.select("key", "node"), hubs, "key").where("node <> hub").select("key", "hub", F.col("node").alias("member")))
    results = written(compared(rows.select("hub", "member").distinct(), words))
    labels = components(results.where(F.greatest("weighted", "plain") >= similar).select(F.col("hub").alias("u"), F.col("member").alias("v")))
    # Rounding must not put a member at the very edge on the wrong side: edges belong to both parts.
    not_far = F.when(F.greatest("weighted", "plain") >= 2 * similar - 1 - 1e-9, F.col("key"))
    not_near = F.when(F.least("weighted", "plain") < similar + 1e-9, F.xxhash64("key"))
    parts = rows.join(results, ["hub", "member"]).select(F.explode(F.array(not_far, not_near)).alias("key"), F.col("member").alias("node"))
    waiting = written(parts.where("key IS NOT NULL"))
    discard(rows, results)
    return labels, waiting


def rarity(words: DataFrame) -> np.ndarray:
    """How often runs occur, by the leading bits of their code; 255 and more count as 255.

    Tasks add up tables of fixed size, whose rows are then added over all tasks; the driver gets
    4 MB. Runs that share a place only seem less rare.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(1 << RARITY_BITS, np.uint8)
        for batch in slices(batches, "words"):
            at, n = np.unique(weighted_runs(texts_of(batch, "words"))[1] >> np.uint64(64 - RARITY_BITS), return_counts=True)
            sizes[at] = np.minimum(sizes[at] + n, 255).astype(np.uint8)
        rows = sizes.reshape(-1, 1 << RARITY_ROW_BITS)
        filled = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array([rows[i].tobytes() for i in filled], pa.binary())], ["row", "sizes"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sums = None, np.zeros(1 << RARITY_ROW_BITS, np.uint16)
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for at, sizes in zip(batch.column("row").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                if row is not None and at != row:
                    done.append((row, sums.astype(np.uint8).tobytes()))
                    sums = np.zeros(1 << RARITY_ROW_BITS, np.uint16)
                row, sums = at, np.minimum(sums + np.frombuffer(sizes, np.uint8), 255)
        if row is not None:
            done.append((row, sums.astype(np.uint8).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], ["row", "sizes"])

    table = np.zeros((1 << (RARITY_BITS - RARITY_ROW_BITS), 1 << RARITY_ROW_BITS), np.uint8)
    counted = in_batches(words.select("words"), count, "row int, sizes binary").repartition("row").sortWithinPartitions("row")
    for row in counted.mapInArrow(add, "row int, sizes binary").collect():
        table[row["row"]] = np.frombuffer(row["sizes"], np.uint8)
    return table.reshape(-1)


def rarest_runs(text: np.ndarray, run: np.ndarray, weight: np.ndarray, texts: int, often: np.ndarray, similar: float) -> np.ndarray:
    """Which runs are among the rarest of their text, so many that texts with a similarity of ``similar`` share one.

    Runs are taken in one order for all texts: rare ones first, ties by code. Plain: of n runs the
    first n - ceil(similar * n) + 1, as similar texts share at least similar * n. Weighted: probability
    Jaccard is at most the common part of the two normalised weights, so the runs that a similar
    text lacks weigh at most 1 - similar; the first runs that weigh more hold a common one. The
    first common run in the order is then among the first of both texts. Both bounds are kept.
    """
    n, _, place, before = places(text, run, weight, texts, often)
    return (place < n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1) | (before <= 1 - similar + 1e-9)


def places(text: np.ndarray, run: np.ndarray, weight: np.ndarray, texts: int, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every run in the order of ``rarest_runs``: runs and weight of its text, number and share of the weight before it."""
    order = np.lexsort((run, often, text))
    n = np.bincount(text, minlength=texts)
    first = np.cumsum(n) - n
    total = np.bincount(text, weights=weight, minlength=texts)
    sums = np.concatenate([[0.0], np.cumsum(weight[order])])
    place, before = np.empty(len(text), np.int64), np.empty(len(text))
    place[order] = np.arange(len(text)) - first[text]
    before[order] = (sums[:-1] - sums[first[text]]) / total[text]
    return n[text], total[text], place, before


def may_be_similar(similar: float) -> Column:
    """Whether two texts can be similar if a run is the first in the order of runs that both have.

    Each text has columns ``n`` (runs), ``weight`` (of them all), ``place`` (runs before that run) and
    ``before`` (their share of the weight), those of the other text with ``hub_`` in front. Plain: what
    comes before is not common, so the texts share at most m = min(n - place) runs, and are similar by
    at most m / (n + n' - m). Weighted: let a and b be the shares that are not common, x and y the
    normalised weights of a common run. The term of that run in probability Jaccard is one over a sum of
    at least 1/x + b/y and at least 1/y + a/x, hence of at least the mean of the two; so it is at most the
    harmonic mean of x / (1 + a) and y / (1 + b), and that at most their mean. All terms make at most
    ((1 - a) / (1 + a) + (1 - b) / (1 + b)) / 2, which falls as a and b rise. What comes before is not
    common, nor are n - m runs of a weight of 1 or more each.
    """
    most = F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place"))
    plain = most / (F.col("n") + F.col("hub_n") - most)

    def common(of: str) -> Column:
        apart = F.greatest(F.col(f"{of}before"), (F.col(f"{of}n") - most) / F.col(f"{of}weight"))
        return (1 - apart) / (1 + apart)

    return F.greatest(plain, (common("") + common("hub_")) / 2) >= similar - 1e-9


def rare_buckets(words: DataFrame, similar: float) -> DataFrame:
    """Nodes that have one of their rarest runs in common; all pairs of similar nodes share a key.

    Columns: key, node, and n, weight, place and before of ``may_be_similar``. Keys sort as the runs do in the
    order of all texts. They keep 55 bits of a run's code: runs that share a key only meet more often.
    """
    often = rarity(words)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, run, weight = weighted_runs(texts_of(batch, "words"))
        seen = often[run >> np.uint64(64 - RARITY_BITS)]
        kept = rarest_runs(text, run, weight, batch.num_rows, seen, similar) & (seen > 1)  # a run that occurs once is shared with none
        key = (seen[kept].astype(np.int64) << 55) | (run[kept] >> np.uint64(9)).view(np.int64)
        node = batch.column("node").take(pa.array(text[kept]))
        return pa.RecordBatch.from_arrays([pa.array(key), node, *[pa.array(p[kept]) for p in places(text, run, weight, batch.num_rows, seen)]], ["key", "node", "n", "weight", "place", "before"])

    rows = by_slices(words.select("node", "words"), "words", work, "key long, node string, n long, weight double, place long, before double")
    buckets = written(rows)
    # Buckets with the same members are one, of their first key: members are digests, so equal sums of both halves mean equal sets.
    halves = [F.conv(F.substring("node", i, 16), 16, 10).cast("decimal(38,0)") for i in (1, 17)]
    sets = buckets.groupBy("key").agg(F.count("*").alias("members"), *[F.sum(h).alias(f"half{i}") for i, h in enumerate(halves)]).where("members > 1")
    chosen = sets.groupBy("members", "half0", "half1").agg(F.min("key").alias("key")).select("key")
    return _rejoin(buckets, chosen, "key")


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets (key, node) whose members are in more than one component, with their labels."""
    live = _rejoin(buckets, labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = live.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return written(_rejoin(live, several, "key"))


def _merged(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels of nodes after components of labels were found, and of the nodes without a label that these hold."""
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return moved.select("node", F.coalesce("to", "label").alias("label")).unionByName(merged.join(labels.select("node"), "node", "left_anti"))


def labels_of(bands: DataFrame, words: DataFrame, similar: float) -> DataFrame:
    """(node, label) of nodes that have a link, from their bands; the others are classes of their own.

    After ``split_by_hub`` only nodes wait whose bucket holds several components. From here on
    buckets are the rarest runs of these nodes (``rare_buckets``), which every similar pair shares and
    texts that only have a passage in common do not. A bucket names hubs round by round,
    ``HUB_GROWTH`` times as many in each, and its members of other components are compared with
    them. Hubs then leave the bucket. Their order is one for all buckets, so a pair is compared in
    one direction. Of the buckets that a pair shares, the one of its first common run bounds its
    similarity by what comes before that run (``may_be_similar``); bounds of later ones are lower, so a
    pair is compared only where the bucket's bound allows it. A bucket is done once the rest of it lies
    in one component; links of a round join components before the next. So each pair of nodes that
    share a band was compared, was already joined, or cannot be similar: of these no link is lost, and
    no bucket is capped. (A pair at exactly 0.8 shares no band once in 14,000 times.)
    """
    labels, waiting = split_by_hub(bands, words, similar)
    hubs_each = 1
    opened = _open(waiting, labels)
    discard(waiting)
    live = None
    if not opened.isEmpty():
        some = written(words.join(opened.select("node").distinct(), "node", "left_semi"))
        live = _open(rare_buckets(some, similar), labels)
        discard(some)
    discard(opened)
    while live is not None and not live.isEmpty():
        rank = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
        hubs = written(live.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= hubs_each).select(
            "key", F.col("node").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("label", "n", "weight", "place", "before")]))
        onwards = F.struct(F.xxhash64("hub"), F.col("hub")) < F.struct(F.xxhash64("node"), F.col("node"))
        pairs = _rejoin(live, hubs, "key").where(F.expr("label <> hub_label") & onwards & may_be_similar(similar))
        pairs = written(pairs.select("hub", F.col("node").alias("member"), "hub_label", "label").distinct())
        linked = compared(pairs.select("hub", "member"), words).where(F.greatest("weighted", "plain") >= similar)
        links = written(pairs.join(linked, ["hub", "member"], "left_semi").select(F.col("hub_label").alias("u"), F.col("label").alias("v")))
        waiting = written(live.join(hubs.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti").drop("label"))
        discard(hubs, pairs, live)
        if not links.isEmpty():
            labels = written(_merged(labels, components(links)))
        live = _open(waiting, labels)
        discard(waiting, links)
        hubs_each *= HUB_GROWTH
    return labels


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(node, class_id, class_node, class_size) of every node.

    class_id is the least id of a class, class_node the node of a row that has it.
    """
    rows = written(banded(docs, id_column, text_column))
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    bands = written(_rejoin(buckets, shared, "key").select("key", "node", "n"))
    texts = docs.select(words_of(F.col(f"`{text_column}`")).alias("words"))
    texts = texts.withColumn("node", node_of(F.col("words"))).join(bands.select("node").distinct(), "node", "left_semi")
    words = written(texts.groupBy("node").agg(F.first("words").alias("words")))
    labels = labels_of(bands, words, similar)
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least_id", "copies")
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node"))
    whole = labelled.groupBy("label").agg(first.alias("first"), F.sum("copies").alias("class_size"))
    whole = whole.select("label", F.col("first.least_id").alias("class_id"), F.col("first.node").alias("class_node"), "class_size")
    found = written(_rejoin(labelled.select("node", "label"), whole, "label").drop("label"))
    discard(rows, nodes, bands, words)
    return found


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similar: float = SIMILAR) -> DataFrame:
    """Every row with its class: doc_id, class_id (least id of the class), class_size (rows), kept.

    Two texts are linked if, over runs of five lower-cased words split at white space, their
    probability Jaccard similarity weighted by occurrences or their plain Jaccard similarity is
    at least ``similar``; a class is what links connect. Texts with the same words are one node
    from the start; null texts and texts without words are one node without links. Exactly one
    row of a class is kept: one with the least id (null ids are never least unless alone). Other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    keys = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), node_of(words_of(F.col(f"`{text_column}`"))).alias("node"))
    counted = keys.groupBy("doc_id", "node").agg(F.count("*").alias("times"))
    joined = _rejoin(counted, classes(docs, id_column, text_column, similar), "node")
    one = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node")) & (F.col("time") == 1)
    return joined.select("doc_id", "class_id", "class_size", "node", "class_node", one).select("doc_id", "class_id", "class_size", stays.alias("kept"))


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: the row that ``near_duplicates`` keeps."""
    def key(node: Column, id_: Column) -> Column:
        return F.concat_ws(":", node, F.coalesce(id_.cast("string"), F.lit("null")))

    name = fresh(docs, "__key")
    stay = classes(docs, id_column, text_column, similar).where("node = class_node").select(key(F.col("class_node"), F.col("class_id")).alias(name))
    marked = docs.withColumn(name, key(node_of(words_of(F.col(f"`{text_column}`"))), F.col(f"`{id_column}`")))
    return marked.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
