"""Approximate nearest neighbours by inner product over balanced posting lists.

A bounded sample is clustered into balanced cells; every vector goes to the lists of the cells
it is about equally near to. A query finds its cells by walking a graph of the centroids that each
task holds in memory, keeps those within a ratio of the nearest distance, and is compared exactly
with all vectors of their lists, in blocks that Spark groups by list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import cut

#: Wanted vectors of a cell, most cells, and sampled vectors for each cell.
CELL_SIZE, MOST_CELLS, SAMPLE_PER_CELL = 256, 4096, 64
#: Links of a centroid in the graph, and how many candidates a walk opens at once, or a 16th of its beam.
LINKS, OPENED = 16, 4
#: A vector is listed in its nearest cells: at least two, then those up to this ratio of the nearest
#: distance, and at most so many. The last number is what its walk keeps.
LIST_RATIO, LEAST_LISTS, MOST_LISTS, LIST_BEAM = 1.15, 2, 6, 24
#: A query reads the lists of its nearest cells by the same rule. The least number keeps up recall
#: where a query lies on a centroid and every other cell is far by ratio. Both numbers grow with the
#: cells: vectors without clusters have their neighbours in a share of all cells, not in a number of them.
PROBE_RATIO, LEAST_PROBES, MOST_PROBES, PROBE_BEAM = 1.2, 32, 48, 64
LEAST_SHARE, MOST_SHARE, BEAM_SHARE = 1 / 8, 1 / 4, 1 / 3
#: Vectors of a list, and queries for it, that one group compares.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 2048


def balanced_cells(points: np.ndarray, cells: int, seed: int = 11, ways: int = 8, rounds: int = 8) -> np.ndarray:
    """Centroids of a hierarchical clustering that goes on splitting the cells that are too large."""
    draw, size = np.random.default_rng(seed), max(1, -(-len(points) // cells))
    todo, centroids = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size * 1.5:
            centroids.append(points[rows].mean(axis=0))
            continue
        k = int(min(ways, max(2, round(len(rows) / size))))
        at = points[rows]
        centers = at[draw.choice(len(rows), k, replace=False)].copy()
        for _ in range(rounds):
            cost = (centers**2).sum(1) - 2 * at @ centers.T
            near = cost.argmin(axis=1)
            held = np.bincount(near, minlength=k)
            # Cells above their share cost more, in units of the mean gap between the two nearest.
            two = np.partition(cost, 1, axis=1)[:, :2]
            cost += (held / len(rows) - 1 / k) * (two[:, 1] - two[:, 0]).mean() * k
            near = cost.argmin(axis=1)
            for c in range(k):
                if (mine := near == c).any():
                    centers[c] = at[mine].mean(axis=0)
        parts = [rows[near == c] for c in range(k)]
        if max(map(len, parts)) == len(rows):  # points too alike to part by distance
            parts = np.array_split(rows, k)
        todo += [p for p in parts if len(p)]
    return np.array(centroids)


@dataclass
class Graph:
    """Centroids and for each the numbers of its neighbours; ``entries`` are where walks begin."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def walk(self, at: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the nearest centroids of every row of ``at``, nearest first.

        All rows walk together: each opens its nearest unopened candidates and keeps the ``beam``
        nearest of what it has seen, until all that it keeps are open.
        """
        beam = min(beam, len(self.centroids))
        entries = self.entries[: max(1, min(len(self.entries), beam))]
        number = np.repeat(entries[None], len(at), axis=0)
        square = (self.centroids**2).sum(axis=1)
        own = (at**2).sum(axis=1)

        def far(rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
            return own[rows, None] + square[cells] - 2 * np.einsum("rcd,rd->rc", self.centroids[cells], at[rows])

        distance = far(np.arange(len(at)), number)
        pad = beam - number.shape[1]
        number = np.concatenate([number, np.full((len(at), pad), -1)], axis=1)
        distance = np.concatenate([distance, np.full((len(at), pad), np.inf)], axis=1)
        opened = np.zeros(number.shape, bool)
        rows = np.arange(len(at))
        while len(rows):
            closed = np.where(opened[rows] | (number[rows] < 0), np.inf, distance[rows])
            going = closed.min(axis=1) < np.inf
            rows, closed = rows[going], closed[going]
            if not len(rows):
                break
            several = min(max(OPENED, beam // 16), beam)
            pick = np.argpartition(closed, several - 1, axis=1)[:, :several]
            first = closed.argmin(axis=1)[:, None]
            pick = np.where(np.take_along_axis(closed, pick, axis=1) < np.inf, pick, first)
            opened[rows[:, None], pick] = True
            new = self.links[number[rows[:, None], pick]].reshape(len(rows), -1)
            n = np.concatenate([number[rows], new], axis=1)
            d = np.concatenate([distance[rows], far(rows, new)], axis=1)
            o = np.concatenate([opened[rows], np.zeros(new.shape, bool)], axis=1)
            order = np.lexsort((~o, n), axis=1)  # equal numbers side by side, the opened one first
            n, d, o = (np.take_along_axis(x, order, axis=1) for x in (n, d, o))
            d[:, 1:][n[:, 1:] == n[:, :-1]] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            n, d, o = (np.take_along_axis(x, order, axis=1) for x in (n, d, o))
            n[d == np.inf] = -1
            number[rows], distance[rows], opened[rows] = n, d, o
        order = np.argsort(distance, axis=1, kind="stable")
        return np.take_along_axis(number, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(distance, order, axis=1), 0))


def graph_of(centroids: np.ndarray, links: int = LINKS, seed: int = 5) -> Graph:
    """Nearest neighbours of each centroid, with a quarter of the links far away at random."""
    n, draw = len(centroids), np.random.default_rng(seed)
    near = min(links - links // 4, n)
    table = np.empty((n, near + links // 4), np.int64)
    square = (centroids**2).sum(axis=1)
    for a in range(0, n, 512):
        cost = square - 2 * centroids[a : a + 512] @ centroids.T
        table[a : a + 512, :near] = np.argsort(cost, axis=1, kind="stable")[:, :near]
    table[:, near:] = draw.integers(0, n, (n, links // 4))
    return Graph(centroids, table, draw.permutation(n)[: min(n, 16)])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def valid(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def probes_of(cells: int) -> tuple[int, int, int]:
    """Least and most lists that a query reads of an index of so many cells, and what its walk keeps."""
    bounds = ((LEAST_PROBES, LEAST_SHARE), (MOST_PROBES, MOST_SHARE), (PROBE_BEAM, BEAM_SHARE))
    return tuple(max(number, int(np.ceil(cells * share))) for number, share in bounds)


def _lists(df: DataFrame, graph: Graph, width: int, longest: float, query: bool) -> DataFrame:
    """(rep_id, embedding, cell) for each list that a vector is in, or that a query reads."""
    probes = PROBE_RATIO, *probes_of(len(graph.centroids))
    ratio, least, most, beam = probes if query else (LIST_RATIO, LEAST_LISTS, MOST_LISTS, LIST_BEAM)
    shared = df.sparkSession.sparkContext.broadcast(graph)

    def work(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                at = _matrix(batch.column("embedding"), width)
                square = (at**2).sum(axis=1)
                # Largest inner product as least distance: vectors get a coordinate that lifts them to
                # one length, queries are scaled to that length and have none.
                if query:
                    at = np.column_stack([at * (longest / np.sqrt(square))[:, None], np.zeros(len(at))])
                else:
                    at = np.column_stack([at, np.sqrt(np.maximum(longest**2 - square, 0))])
                number, distance = shared.value.walk(at, beam)
                number, distance = number[:, :most], distance[:, :most]
                row, place = np.nonzero((number >= 0) & ((distance <= ratio * distance[:, :1]) | (np.arange(number.shape[1]) < least)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).take(pa.array(row)) for n in ("rep_id", "embedding")] + [pa.array(number[row, place], pa.int32())],
                    ["rep_id", "embedding", "cell"],
                )

    return df.mapInArrow(work, "rep_id long, embedding array<float>, cell int")


def _best(queries: DataFrame, vectors: DataFrame, width: int, wanted: int) -> DataFrame:
    """(query_rep, rep_id, score): the ``wanted`` best of each block of a list for each query that reads it."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _matrix(left.column("embedding"), width), _matrix(right.column("embedding"), width)
        ids, asked = right.column("rep_id").to_numpy(), left.column("rep_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        scores = q @ v.T
        n = min(wanted, len(ids))
        # Everything that may tie with the last wanted one within rounding is scored exactly.
        least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n] if n else np.zeros(len(q))
        row, place = np.nonzero(scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        exact = (q[row] * v[place]).sum(axis=1)
        sort = np.lexsort((place, -exact, row))
        row, place, exact = row[sort], place[sort], exact[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < n
        return pa.table({"query_rep": asked[row[keep]], "rep_id": ids[place[keep]], "score": exact[keep]})

    keys = ["cell", "block", "slice"]
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(work, "query_rep long, rep_id long, score double")


def search(rows: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest of every query by inner product: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the id column; candidates are all rows but the query's own.
    Ties go to the smaller id. Vectors that ``valid`` refuses, vectors of another width than the
    most common one, and null ids take no part; of rows that share an id, the least vector does.
    Other columns are not read; an empty table gives no rows.

    Equal vectors are searched once, by their least id, and only their k + 1 least ids can be among
    anyone's k nearest, so a vector that fills a third of the table is one entry of the index.
    Lists and the queries that read them are cut into blocks of bounded size. The centroids and
    their graph, at most ``MOST_CELLS``, are all that is broadcast; the driver sees a sample of
    at most ``SAMPLE_PER_CELL`` vectors for each.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<float>").alias("embedding"))
    good = good.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    good = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = good.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    width = sizes["width"]
    good = good.where(F.size("embedding") == width)
    asked = is_query.alias("asked")
    # One row a vector: its least id, its copies, and whether a query has it.
    reps = cut(good.select("vec_id", "embedding", asked).groupBy("embedding").agg(
        F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"), F.max("asked").alias("asked")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = reps.agg(F.count("*"), F.sqrt(F.max(square))).first()
    cells = int(np.clip(-(-n // CELL_SIZE), 1, MOST_CELLS))
    chosen = reps.orderBy(F.xxhash64("rep_id"), "rep_id").select("embedding").limit(cells * SAMPLE_PER_CELL)
    points = _matrix(chosen.toArrow().column("embedding"), width)
    lift = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    graph = graph_of(balanced_cells(np.column_stack([points, lift]), cells))

    lists = _lists(reps.select("rep_id", "embedding"), graph, width, longest, query=False)
    probes = _lists(reps.where("asked").select("rep_id", "embedding"), graph, width, longest, query=True)
    lists, probes = cut(lists), cut(probes)
    # How many blocks a list and its queries take: at most MOST_CELLS rows.
    blocks = lists.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    parts = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("slices"))
    shape = F.broadcast(blocks.join(parts, "cell"))

    def dealt(df: DataFrame, own: str, of: str, other: str, every: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("rep_id"), F.col(of)).cast("int").alias(own)
        return df.join(shape, "cell").select("rep_id", "embedding", "cell", mine, F.explode(F.sequence(F.lit(0), F.col(every) - 1)).alias(other))

    found = _best(dealt(probes, "slice", "slices", "block", "blocks"), dealt(lists, "block", "blocks", "slice", "slices"), width, k + 1)
    found = found.groupBy("query_rep", "rep_id").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep_id")
    found = found.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1).drop("at")
    # Copies: the k + 1 least ids of each vector that has several.
    several = reps.where("copies > 1").select("embedding", "rep_id")
    of_rep = Window.partitionBy("rep_id").orderBy("vec_id")
    copies = good.join(several, "embedding").select("rep_id", "vec_id").withColumn("at", F.row_number().over(of_rep)).where(F.col("at") <= k + 1).drop("at")
    listed = found.join(copies, "rep_id", "left").select("query_rep", F.coalesce("vec_id", "rep_id").alias("vec_id"), "score")
    near = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1).drop("at")
    queries = good.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    queries = queries.join(reps.where("asked").select("embedding", F.col("rep_id").alias("query_rep")), "embedding").select("query_id", "query_rep")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(listed, "query_rep").where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
