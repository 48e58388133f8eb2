"""Lines that many documents share, by levelled sorted runs of line hashes.

An index of lines is a set of runs: Parquet tables bucketed and sorted by line hash, with the number
of documents of each line. Documents come in batches. A batch is merge-anti-joined with the runs of
lines already known to be frequent, and what is left becomes a run of level 0. When a level holds
``fanout`` runs they are merged into one run of the next level; lines that reach the limit there
move to the runs of frequent lines. Everything is DataFrame code without Python workers.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import remove, shared_folder, written

#: What is stripped at both ends of a line: space and tab to carriage return.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches that the documents of one call are taken in, runs of a level before they are merged, buckets of a run.
BATCHES, FANOUT, BUCKETS = 4, 2, 16
#: At most so many lines are looked up by broadcast: those in one of so many of all pairs of document and line.
HOT_LINES = 4096


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() changes only A-Z where all characters are ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _digest(text: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


class LineIndex:
    """Runs of line hashes: ``add`` takes the documents of a batch, ``frequent`` gives lines at the limit.

    A run has (line, docs), one row a line, in ``buckets`` buckets sorted by line, so merging runs
    and joining with them moves only the batch. Runs that were merged are deleted. A line counts
    once a document; the counts of a frequent line stop when it is settled.
    """

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int = FANOUT, buckets: int = BUCKETS) -> None:
        self.spark, self.least_docs, self.fanout, self.buckets = spark, least_docs, fanout, buckets
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.settled: list[str] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = counts.repartition(self.buckets, "line")
        writer = dealt.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line")
        writer.option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Sum of runs by merge joins, which read the buckets where they are.

        Not a union under a group-by: over bucketed tables Spark 4.1.2 summed each run apart.
        """
        runs = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("docs", "more").hint("merge")
            both = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            runs = runs.join(other, "line", "full").select("line", both.alias("docs"))
        return runs

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{shared_folder(self.spark)}/{name}")

    def _merge(self, names: list[str]) -> str:
        """One run of the lines below the limit; those at it move to a run of frequent lines."""
        merged = self._merged(names)
        self.settled.append(self._write(merged.where(F.col("docs") >= self.least_docs)))
        below = self._write(merged.where(F.col("docs") < self.least_docs))
        self._drop(names)
        if len(self.settled) > self.fanout:
            merged_settled = self._write(self._merged(self.settled))
            self._drop(self.settled)
            self.settled = [merged_settled]
        return below

    def add(self, lines: DataFrame) -> None:
        """``lines`` has one array ``lines`` of distinct hashes a document."""
        counts = lines.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("docs"))
        for name in self.settled:
            counts = counts.join(self.spark.table(name).hint("merge"), "line", "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels.pop(level)
            level += 1
            self.levels[level].append(self._merge(full))

    def frequent(self) -> DataFrame:
        """Lines of at least ``least_docs`` documents: line, docs (as far as they were counted)."""
        rest = [name for names in self.levels.values() for name in names]
        if len(rest) > 1 or self.levels[0]:  # a single run of a higher level holds nothing at the limit
            self.levels = defaultdict(list, {max(self.levels): [self._merge(rest)]})
        return self._merged(self.settled) if self.settled else self.spark.createDataFrame([], "line binary, docs long")


def drop_common_lines(
    docs: DataFrame, least_docs: int, least_chars: int = 1, id_column: str = "doc_id", text_column: str = "text",
    batches: int = BATCHES, fanout: int = FANOUT, buckets: int = BUCKETS,
) -> DataFrame:
    """Documents without the lines that at least ``least_docs`` of them hold: doc_id, n_lines, n_dropped, kept_text.

    Texts are split at newlines; a null or empty text is one empty line. Lines are equal by
    :func:`line_key`, and keys of fewer than ``least_chars`` code points are never dropped. Every
    row counts as a document, rows that repeat another too, and has one row in the result; a
    null id is kept as it is. A line that repeats within a document counts once and is dropped
    everywhere. All lines dropped: an empty text. Other columns are not read, whatever their
    names; an empty table gives no rows.

    Documents are dealt to ``batches`` batches by a hash. Lines that are in a 4,096th of all pairs of
    document and line (at most 4,096 lines) are looked up by broadcast, so that no task gets the
    rows of a line that a third of the documents hold; the others by a shuffle on the line.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    whole = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"))
    whole = whole.withColumn("row", _digest(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\n"), "text")))
    keys = F.transform(F.split("text", "\n"), line_key)
    hashed = written(
        whole.select(
            "row", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"),
            F.transform(keys, lambda k: F.when(F.char_length(k) >= least_chars, _digest(k))).alias("hashes"),
        )
    )
    distinct = F.array_distinct(F.array_compact("hashes")).alias("lines")
    index = LineIndex(docs.sparkSession, least_docs, fanout, buckets)
    for batch in range(batches):
        index.add(hashed.where(F.col("batch") == batch).select(distinct))
    pairs = hashed.agg(F.sum(F.size(distinct))).first()[0] or 0
    frequent = index.frequent()
    hot = F.col("docs") >= max(least_docs, -(-pairs // HOT_LINES))

    lines = hashed.select("row", F.posexplode("hashes").alias("at", "line")).where(F.col("line").isNotNull())
    by_broadcast = F.broadcast(frequent.where(hot).select("line", F.lit(True).alias("hot")))
    marked = lines.join(by_broadcast, "line", "left")
    shuffled = marked.where(F.col("hot").isNull()).select("row", "at", "line").join(frequent.where(~hot), "line", "left_semi")
    common = marked.where("hot").select("row", "at").unionAll(shuffled.select("row", "at"))
    dropped = common.groupBy("row").agg(F.collect_set("at").alias("dropped"))

    n_lines = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped"))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    return (
        whole.join(dropped, "row", "left").withColumn("lines", F.split("text", "\n"))
        .select(
            "doc_id", n_lines.cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept_text).alias("kept_text"),
        )
    )
