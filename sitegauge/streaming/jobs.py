"""Structured Streaming jobs over the batch operators.

Every job reads a file stream, keeps its checkpoint and its output in the folder given, and can
be restarted from there. ``run_available`` drives a job over the files present; a service would
start the same query with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sitegauge.functions.prices import strip_price
from sitegauge.operators.accounts import COMPLETED, DELETED, UPDATED, rate_limit_column
from sitegauge.operators.prices import ORDER
from sitegauge.operators.scores import page_score

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """File stream with the schema of the files present; NTZ timestamps become timestamps.

    The path is given as a pattern that matches just itself: a table may then be a single file
    as well as a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    casts = {n: F.col(n).cast("timestamp") for n, t in stream.dtypes if t == "timestamp_ntz"}
    return stream.withColumns(casts) if casts else stream


def run_available(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a query over the files present; returns the output path."""
    output = f"{folder}/output"
    writer: DataStreamWriter = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    if each is None and mode == "append":
        writer = writer.format("parquet").option("path", output)
    else:
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            # One folder per batch: a batch repeated after a failure overwrites its own output.
            batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

        writer = writer.foreachBatch(each or write_batch)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return output


# --- stateless -----------------------------------------------------------------------------


def page_audit(pages: DataFrame) -> DataFrame:
    """The batch audit is one projection, so it is the streaming audit too."""
    return page_score(pages)


# --- event time ----------------------------------------------------------------------------


def rate_counts(log: DataFrame, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Requests per client, route and window; rows later than ``lateness`` are dropped."""
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "client", "route").agg(F.count("*").alias("n"))
        .select("client", "route", F.col("window.start").alias("window_start"), "n")
    )


def final_breaches(spark: SparkSession, output: str, limit: Column | None = None) -> DataFrame:
    """Breaches from the update-mode output: counts only grow, so the largest one is final."""
    counts = spark.read.parquet(output).groupBy("client", "route", "window_start").agg(F.max("n").alias("n"))
    limited = counts.withColumn("limit", rate_limit_column(F.col("route")) if limit is None else limit)
    return limited.where(F.col("n") > F.col("limit"))


# --- keyed state ---------------------------------------------------------------------------


def _groups(table: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
    """First rows of the runs of equal keys in sorted rows, and the offsets of the runs."""
    codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return pa.array(starts), np.append(starts, len(codes)).astype(np.int32)


def _sorted(batches: Iterator[pa.RecordBatch], names: list[str]) -> pa.Table | None:
    """All rows of a task in order; a task holds one range of a micro-batch."""
    held = list(batches)
    return pa.Table.from_batches(held).sort_by([(n, "ascending") for n in names]) if any(b.num_rows for b in held) else None


#: What a packed row of the price state is: all points of a product in the batch, the points of a
#: product that other slices may have too, the first and last of those, a new threshold.
WHOLE, INNER, EDGE, THRESHOLD = range(4)
#: Keys over which the slices of one product are dealt.
SALTS = 8
#: Keys over which products are dealt. A call of the state's Python code takes milliseconds and a read or
#: write of one entry a tenth of one, so a call serves a bucket, in which each product has its own entry.
BUCKETS = 1024


def price_slices(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Points of a batch packed by product and slice, in order.

    Rows are range-partitioned by product and order. A product inside a slice is complete there
    and becomes one row. One at the border of a slice may go on in the next: its points become a
    row of a salted key, which needs no state before it, and only its first and last point go to
    the key that holds its state. So a product may fill a batch by itself.
    """
    names = ["product", *[c for c in order if c != "product"]]
    rows = points.select(*names, "price", F.unix_micros("captured_at").alias("_at"))
    product = rows.schema["product"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _sorted(batches, names)
        if table is None:
            return
        part = TaskContext.get().partitionId()
        first, offsets = _groups(table, "product")
        n = len(first)
        prices, times = (table.column(c).combine_chunks() for c in ("price", "_at"))
        border = np.unique([0, n - 1])
        edges = [np.unique([offsets[g], offsets[g + 1] - 1]) for g in border]
        ends, edge_offsets = pa.array(np.concatenate(edges)), pa.array(np.cumsum([0, *map(len, edges)]).astype(np.int32))
        order_of = pa.array(np.concatenate([np.arange(1, n - 1), border, border]) if n > 1 else np.array([0, 0]))
        plain = pa.array(np.concatenate([np.arange(1, n - 1), border]) if n > 1 else np.array([0]))

        def lists(values: pa.Array) -> pa.Array:
            whole = pa.ListArray.from_arrays(pa.array(offsets), values).take(plain)
            return pa.concat_arrays([whole, pa.ListArray.from_arrays(edge_offsets, values.take(ends))])

        inside, at_border = max(n - 2, 0), len(border)
        kinds = np.repeat([WHOLE, INNER, EDGE], [inside, at_border, at_border]).astype(np.int32)
        batch = pa.RecordBatch.from_arrays(
            [
                table.column("product").combine_chunks().take(first).take(order_of),
                pa.array(np.where(kinds == INNER, 1 + part % SALTS, 0).astype(np.int32)), pa.array(kinds),
                pa.array(np.full(len(kinds), part, np.int32)), lists(prices), lists(times), pa.nulls(len(kinds), pa.float64()),
            ],
            ["product", "salt", "kind", "slice", "prices", "times", "threshold"],
        )
        yield from (batch.slice(i, 10_000) for i in range(0, batch.num_rows, 10_000))

    return rows.repartitionByRange(*names).mapInArrow(
        pack, f"product {product}, salt int, kind int, slice int, prices array<double>, times array<bigint>, threshold double"
    )


class PriceState(StatefulProcessor):
    """Last price and threshold of the products of a bucket; alerts of the points of a batch.

    The first key of a bucket has an entry for each product. The others see only slices of products
    that fill much of a batch and keep the thresholds alone, as a log that is read when such a slice comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.products = handle.getMapState("products", "name string", "price double, threshold double")
        self.log = handle.getListState("log", "names array<string>, thresholds array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        limits = table[table["kind"] == THRESHOLD]
        given = {name: float(limit) if limit > 0 else None for name, limit in zip(limits["name"], limits["threshold"], strict=True)}
        yield from self._slices(given, table[table["kind"] == INNER]) if key[1] else self._products(given, table[table["kind"] != THRESHOLD])

    def _slices(self, given: dict[str, float | None], inner: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if given:
            self.log.appendValue((list(given), list(given.values())))
        if len(inner):
            known, entries = {}, 0
            for names, limits in self.log.get() if self.log.exists() else ():
                known.update(zip(names, limits, strict=True))
                entries += len(names)
            if entries > 2 * len(known):
                self.log.put([(list(known), list(known.values()))])
            yield _alerts(inner, np.nan, [known.get(name) for name in inner["name"]])

    def _products(self, given: dict[str, float | None], points: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = self.products.exists()
        before = {name: self.products.getValue((name,)) if known else None for name in dict.fromkeys([*given, *points["name"]])}
        state = {name: [None, None] if seen is None else list(seen) for name, seen in before.items()}
        for name, limit in given.items():
            state[name][1] = limit
        whole = points[points["kind"] == WHOLE]
        if len(whole):
            yield _alerts(whole, [state[name][0] for name in whole["name"]], [state[name][1] for name in whole["name"]])
            for name, prices in zip(whole["name"], whole["prices"], strict=True):
                state[name][0] = float(prices[-1])
        edges = points[points["kind"] == EDGE].sort_values("slice")
        if len(edges):
            last = []
            for name, prices in zip(edges["name"], edges["prices"], strict=True):
                last.append(state[name][0])
                state[name][0] = float(prices[-1])
            # Thresholds of these points are looked up where their slices are.
            firsts = edges.assign(prices=[p[:1] for p in edges["prices"]], times=[t[:1] for t in edges["times"]])
            yield _alerts(firsts, last, [None] * len(edges))
        for name, now in state.items():
            if now == [None, None]:
                if before[name] is not None:
                    self.products.removeKey((name,))
            elif before[name] is None or now != list(before[name]):
                self.products.updateValue((name,), tuple(now))

    def close(self) -> None:
        pass


def _alerts(rows: pd.DataFrame, last: float | list[float | None], limits: list[float | None]) -> pd.DataFrame:
    """Alerts of packed points; the first of a row is compared with its ``last``, none without."""
    lengths = np.array([len(p) for p in rows["prices"]])
    owner = np.repeat(np.arange(len(rows)), lengths)
    curr, at = np.concatenate(list(rows["prices"])).astype(float), np.concatenate(list(rows["times"])).astype(np.int64)
    prev = np.concatenate([[np.nan], curr[:-1]])
    prev[np.cumsum(lengths) - lengths] = np.asarray(last, float)
    limit = np.asarray(limits, float)[owner]
    changed, low = np.flatnonzero(~np.isnan(prev) & (prev != curr)), np.flatnonzero(curr <= limit)
    both = np.concatenate([changed, low])
    return pd.DataFrame({
        "name": rows["name"].to_numpy()[owner[both]], "at": at[both], "prev": np.concatenate([prev[changed], np.full(len(low), np.nan)]), "curr": curr[both],
        "direction": np.concatenate([np.where(curr[changed] < prev[changed], "drop", "increase"), np.full(len(low), "threshold")]).astype(object),
        "threshold": np.concatenate([np.full(len(changed), np.nan), limit[low]]),
    })


def price_alerts(points: DataFrame, thresholds: DataFrame | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Alerts of every readable point of a stream: product, captured_at, prev, curr, direction, threshold.

    ``drop`` or ``increase``: the price differs from that of the point before; ``threshold``: it is
    not above the product's threshold. Points are taken batch by batch, in a batch by ``order``.
    ``thresholds`` is a stream of product and threshold: a later one replaces the one before, 0 and
    null remove it, and it holds from its own batch on. Price and threshold of a product are an entry
    of keyed state in RocksDB, so a batch costs what its own products cost, however many are known.
    """
    readable = points.withColumn("price", strip_price(F.col("price_text"))).where(F.col("price").isNotNull())
    packed = price_slices(readable, order)
    # A null product has a name too: the entries of a bucket have no null keys.
    name = F.coalesce(F.concat(F.lit("="), F.col("product").cast("string")), F.lit("")).alias("name")
    product = packed.schema["product"].dataType
    packed = packed.select(name, "salt", "kind", "slice", "prices", "times", "threshold")
    if thresholds is not None:
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS + 1)]))
        packed = packed.unionByName(
            thresholds.withColumn("product", F.col("product").cast(product)).select(
                name, salts.alias("salt"), F.lit(THRESHOLD).alias("kind"), F.lit(0).alias("slice"), F.lit(None).cast("array<double>").alias("prices"),
                F.lit(None).cast("array<bigint>").alias("times"), F.col("threshold").cast("double").alias("threshold"),
            )
        )
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int").alias("bucket")
    alerts = packed.select(bucket, "*").groupBy("bucket", "salt").transformWithStateInPandas(
        PriceState(), "name string, at bigint, prev double, curr double, direction string, threshold double", "Update", "none"
    )
    found = F.when(F.col("name") != "", F.expr("substring(name, 2)")).cast(product).alias("product")
    given = {c: F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("prev", "threshold")}
    return alerts.select(found, F.timestamp_micros("at").alias("captured_at"), given["prev"], "curr", "direction", given["threshold"])


def price_changes(points: DataFrame, folder: str, order: tuple[str, ...] = ORDER, thresholds: DataFrame | None = None) -> str:
    """Run :func:`price_alerts` over the files present; returns the output path."""
    use_rocksdb(points.sparkSession)
    return run_available(price_alerts(points, thresholds, order), folder, "update")


class LastCapture(StatefulProcessor):
    """Time of the last capture that was kept; gone by a timer when it can no longer refuse one."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at bigint")

    def _expiry(self, at: int) -> int:
        return -(-(at + self.every) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrays = [np.asarray(times, np.int64) for chunk in rows for times in chunk["times"]]
        times = np.sort(np.concatenate(arrays))
        times = times[times >= timerValues.getCurrentWatermarkInMs() * 1000]
        before = self.kept.get()
        found, last, at = [], None if before is None else before[0], 0
        while at < len(times):
            if last is not None:
                at = int(np.searchsorted(times, last + self.every))
                if at == len(times):
                    break
            last = int(times[at])
            found.append(last)
        if found:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before[0]))
            self.kept.update((last,))
            self.handle.registerTimer(self._expiry(last))
            yield pd.DataFrame({"url": [key[0]] * len(found), "at": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def capture_dedup(captures: DataFrame, seconds: int = 3600) -> DataFrame:
    """One capture per URL until ``seconds`` have passed since the kept one: url, fetched_at.

    The state of a URL is the time of its last kept capture and a timer that removes it. Captures
    that come later than ``seconds`` behind the stream are dropped; one before the kept capture is
    a repetition of it. Files in order of time give the same rows however they are cut into
    batches. Captures of a batch are packed by URL and slice of time first.
    """
    rows = captures.select("url", F.unix_micros("fetched_at").alias("_at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _sorted(batches, ["url", "_at"])
        if table is None:
            return
        first, offsets = _groups(table, "url")
        times = table.column("_at").combine_chunks()
        batch = pa.RecordBatch.from_arrays(
            [
                table.column("url").combine_chunks().take(first), pa.ListArray.from_arrays(pa.array(offsets), times),
                times.take(pa.array(offsets[1:] - 1)).cast(pa.timestamp("us", "UTC")),
            ],
            ["url", "times", "newest"],
        )
        yield from (batch.slice(i, 10_000) for i in range(0, batch.num_rows, 10_000))

    packed = rows.repartitionByRange("url", "_at").mapInArrow(pack, "url string, times array<bigint>, newest timestamp")
    kept = packed.withWatermark("newest", f"{seconds} seconds").groupBy("url").transformWithStateInPandas(
        LastCapture(seconds * 1_000_000), "url string, at bigint", "Update", "EventTime"
    )
    return kept.select("url", F.timestamp_micros("at").alias("fetched_at"))


class Subscriptions(StatefulProcessor):
    """Latest subscription state per customer; events older than the state are ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "premium boolean, since timestamp, ts timestamp, event_id long, email string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Only the newest checkout and the newest event of the batch can decide.
        newest = checkout = None
        for chunk in rows:
            chunk = chunk.sort_values(["ts", "event_id"])
            last = chunk.iloc[-1]
            if newest is None or (last.ts, last.event_id) > (newest.ts, newest.event_id):
                newest = last
            done = chunk[chunk["type"] == COMPLETED]
            if len(done) and (checkout is None or (done.iloc[-1].ts, done.iloc[-1].event_id) > (checkout.ts, checkout.event_id)):
                checkout = done.iloc[-1]
        known = self.state.exists()
        seen = self.state.get() if known else None
        if seen is not None and (newest.ts, newest.event_id) <= (seen[2], seen[3]):
            return
        if checkout is None and not known and not bool(newest.known_customer):
            return
        active = newest.type == COMPLETED or (newest.type == UPDATED and newest.status == "active")
        since = newest.ts.to_pydatetime() if active else None
        email = checkout.email if checkout is not None else seen[4] if seen is not None else newest.email
        self.state.update((bool(active), since, newest.ts.to_pydatetime(), int(newest.event_id), email))
        yield pd.DataFrame({
            "customer_id": [key[0]], "email": [email], "premium": [bool(active)], "since": [since],
            "ts": [newest.ts], "event_id": [int(newest.event_id)],
        })

    def close(self) -> None:
        pass


def subscription_updates(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """State changes per customer; events of unknown accounts are ignored.

    As in the batch fold, a completed checkout is matched by e-mail, a deleted or updated
    subscription by customer id: one that the accounts know or that a checkout has set. The latter
    need not carry an e-mail.
    """
    relevant = events.where(F.col("type").isin(COMPLETED, DELETED, UPDATED))
    columns = ("customer", "email", "type", "status", "ts", "event_id")
    owners = accounts.select("email", F.col("customer_id").alias("owner")).where(F.col("owner").isNotNull())
    checkouts = relevant.where(F.col("type") == COMPLETED).select(*columns).join(
        accounts.select("email", F.col("customer_id").alias("owner")), "email")
    changes = relevant.where(F.col("type") != COMPLETED).select(*[c for c in columns if c != "email"]).join(
        owners, F.col("customer") == F.col("owner"), "left")
    known = F.col("owner").isNotNull().alias("known_customer")
    both = checkouts.select(*columns, known).unionByName(changes.select(*columns, known))
    return both.groupBy("customer").transformWithStateInPandas(
        Subscriptions(), "customer_id string, email string, premium boolean, since timestamp, ts timestamp, event_id long", "Update", "none"
    )


def latest_state(spark: SparkSession, output: str) -> DataFrame:
    """Last state per customer from the written updates."""
    newest = spark.read.parquet(output).groupBy("customer_id", "email").agg(F.max(F.struct("ts", "event_id", "premium", "since")).alias("s"))
    return newest.select("email", "customer_id", "s.premium", "s.since")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of arbitrary size lives in RocksDB, not on the executor heap; a batch uploads what it changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
