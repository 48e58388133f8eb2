"""Price points: append, history, alerts, comparison and report tables.

Points have ``product``, ``store``, ``price_text`` and ``captured_at``. Any product may hold a
large share of all points, so nothing here sorts or collects a whole product: rank filters run
as group limits before the shuffle, extrema and latest values are aggregates with map-side
combine, and frames over time work on one row per product and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.constants import PRICE_POINTS
from sitegauge.functions.numbers import rounded
from sitegauge.functions.prices import currency_of, parse_price, strip_price
from sitegauge.operators.joins import join_reduced

# Total order of the points of one product, oldest first.
ORDER = ("captured_at", "store", "price_cents", "l_orderkey", "l_linenumber")


def _latest_rank(keys: tuple[str, ...], order: tuple[str, ...] = ORDER) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))


def price_values(points: DataFrame) -> DataFrame:
    """Points with the parsed value and the currency, as they are appended."""
    return points.withColumns({
        "price_value": parse_price(F.col("price_text")), "currency": currency_of(F.col("price_text"))
    })


def price_latest(points: DataFrame, limit: int = PRICE_POINTS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The newest ``limit`` points of every product with their rank."""
    ranked = price_values(points).withColumn("rank", _latest_rank(("product",), order))
    return ranked.where(F.col("rank") <= limit)


def price_history(points: DataFrame, limit: int = PRICE_POINTS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Count and extrema of all points of a product, its current text, and the series of its newest ``limit`` points, oldest first."""
    valued = price_values(points)
    whole = valued.groupBy("product").agg(
        F.count("*").alias("points"), F.min("price_value").alias("lowest"), F.max("price_value").alias("highest"))
    entry = F.struct((-F.col("rank")).alias("i"), "captured_at", "price_text", "price_value", "currency")
    series = price_latest(points, limit, order).groupBy("product").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    newest = F.element_at("entries", -1)
    # Both sides have one row a product.
    return whole.withColumnRenamed("product", "_product").join(series, F.col("_product").eqNullSafe(F.col("product"))).select(
        "product", "points", "lowest", "highest", newest["price_text"].alias("current_price"), newest["currency"].alias("currency"),
        F.transform("entries", lambda e: F.struct(e["captured_at"], e["price_text"], e["price_value"])).alias("history"),
    )


def with_previous(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """Add the value of the preceding row of the key, without ever holding a whole key in a task.

    Rows are range-partitioned by key and order, so a large key is cut into consecutive slices.
    The lag is taken inside the slices; a second window over just the first and last row of each
    slice carries the value across the cuts.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    marked = ranged.withColumns({
        "_inner": F.lag(value).over(inner),
        "_first": F.row_number().over(inner) == 1,
        "_last": F.lead(F.lit(1)).over(inner).isNull(),
    }).withColumn("_group", F.when(F.col("_first") | F.col("_last"), -1).otherwise(F.col("_slice")))
    across = F.lag(value).over(Window.partitionBy(*keys, "_group").orderBy(*order))
    carried = marked.withColumn("_edge", across).withColumn(name, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_inner")))
    return carried.drop("_slice", "_inner", "_first", "_last", "_group", "_edge")


def _last_two(points: DataFrame, value: Column, keys: tuple[str, ...], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Current and previous value by key."""
    ranked = points.withColumn("value", value).withColumn("rank", _latest_rank(keys, order)).where(F.col("rank") <= 2)

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    return ranked.groupBy(*keys).agg(
        at(2, "value").alias("prev"), at(1, "value").alias("curr"), at(1, "captured_at").alias("captured_at"),
        F.count("*").alias("n"),
    )


def _change(pairs: DataFrame) -> DataFrame:
    pct = rounded(F.abs(F.col("curr") - F.col("prev")) / F.nullif(F.col("prev"), F.lit(0.0)) * 100, 1)
    direction = F.when(F.col("curr") < F.col("prev"), "drop").when(F.col("curr") > F.col("prev"), "increase")
    return pairs.withColumns({"pct": pct, "direction": direction}).where(F.col("direction").isNotNull())


def change_message(prev: Column, curr: Column) -> Column:
    verb = F.when(curr < prev, "dropped").otherwise("increased")
    pct = F.abs(curr - prev) / F.nullif(prev, F.lit(0.0)) * 100
    return F.when(pct.isNull(), F.format_string("Price %s: $%.2f -> $%.2f", verb, prev, curr)).otherwise(
        F.format_string("Price %s %.1f%%: $%.2f -> $%.2f", verb, pct, prev, curr)
    )


def price_change_alerts(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Change between the last two readable prices of a product; a zero before gives no percent."""
    readable = points.where(strip_price(F.col("price_text")).isNotNull())
    pairs = _last_two(readable, strip_price(F.col("price_text")), ("product",), order)
    return _change(pairs).select(
        "product", "prev", "curr", "pct", "direction", change_message(F.col("prev"), F.col("curr")).alias("message")
    )


def price_threshold_alerts(points: DataFrame, thresholds: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Products whose current readable price is at or below their threshold; 0 and null disable."""
    readable = points.withColumn("value", strip_price(F.col("price_text"))).where(F.col("value").isNotNull())
    current = readable.groupBy("product").agg(F.max_by("value", F.struct(*order)).alias("curr"))
    active = thresholds.where(F.col("threshold") > 0)
    return current.join(active, "product").where(F.col("curr") <= F.col("threshold")).select("product", "curr", "threshold")


def price_drop_strict(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Drop between the last two raw entries; unreadable ones give none."""
    pairs = _last_two(points, strip_price(F.col("price_text"), "$,"), ("product",), order)
    dropped = _change(pairs.where(F.col("prev").isNotNull() & F.col("curr").isNotNull()))
    return dropped.where(F.col("direction") == "drop").select("product", "prev", "curr", "pct")


def price_series(points: DataFrame) -> DataFrame:
    """Readable points as ``(product, date, price)`` with the extrema of the product."""
    readable = points.withColumn("price", strip_price(F.col("price_text"))).where(F.col("price").isNotNull())
    bounds = readable.groupBy("product").agg(F.min("price").alias("lowest"), F.max("price").alias("highest"))
    return join_reduced(readable.select("product", F.to_date("captured_at").alias("date"), "price"), bounds, "product")


def price_csv(points: DataFrame) -> DataFrame:
    """Export columns ``timestamp, price, title, error``; missing values are empty."""
    return points.select(
        F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.coalesce("price_text", F.lit("")).alias("price"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("error", F.lit("")).alias("error"),
    )


def store_prices(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Latest readable price by product and store."""
    readable = points.withColumn("price", strip_price(F.col("price_text"))).where(F.col("price").isNotNull())
    return readable.groupBy("product", "store").agg(
        F.max_by("price", F.struct(*order)).alias("price"), F.max("captured_at").alias("last_checked")
    )


def price_report_products(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Store comparison: latest price, best-price flag and savings against the dearest store."""
    current = store_prices(points, order)
    bounds = current.groupBy("product").agg(F.min("price").alias("best"), F.max("price").alias("dearest"))
    return join_reduced(current, bounds, "product").select(
        "product", "store", "price", (F.col("price") == F.col("best")).alias("is_best_price"),
        rounded(F.col("dearest") - F.col("price"), 2).alias("savings"), "last_checked",
    )


def price_report_alerts(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Change between the last two readable prices by product and store."""
    readable = points.where(strip_price(F.col("price_text")).isNotNull())
    pairs = _last_two(readable, strip_price(F.col("price_text")), ("product", "store"), order)
    return _change(pairs).select(
        "product", "store", F.col("prev").alias("previous_price"), F.col("curr").alias("current_price"),
        F.col("pct").alias("change_pct"), (F.col("direction") == "drop").alias("is_drop"), F.to_date("captured_at").alias("date"),
    )


def price_report_summary(points: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Products, stores, average current price and price drops, one row.

    Current and previous prices by product and store are found once, for averages and drops alike;
    they are reduced by product first. Stores need no order of their points.
    """
    readable = points.where(strip_price(F.col("price_text")).isNotNull())
    pairs = _last_two(readable, strip_price(F.col("price_text")), ("product", "store"), order)
    per_product = pairs.groupBy("product").agg(
        F.sum("curr").alias("total"), F.count("*").alias("n"), F.count_if(F.col("curr") < F.col("prev")).alias("drops"))
    parts = [
        per_product.agg(F.count("*").alias("num_products"), rounded(F.sum("total") / F.sum("n"), 2).alias("avg_price"),
                        F.coalesce(F.sum("drops"), F.lit(0)).alias("price_drops")),
        readable.select("store").distinct().agg(F.count("*").alias("num_stores")),
    ]
    # Two one-row results side by side: stacked and folded, no join needed.
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("num_products", "num_stores", "avg_price", "price_drops")])


def price_trend_30d(points: DataFrame, days: int = 30) -> DataFrame:
    """Trailing extrema and average by product and day, over one row per product and day."""
    daily = (
        points.withColumn("price", strip_price(F.col("price_text"))).where(F.col("price").isNotNull())
        .groupBy("product", F.to_date("captured_at").alias("date"))
        .agg(F.sum((F.col("price") * 100).cast("decimal(20,0)")).alias("cents"), F.count("*").alias("n"),
             F.min("price").alias("low"), F.max("price").alias("high"))
    )
    frame = Window.partitionBy("product").orderBy(F.unix_date("date")).rangeBetween(-days, 0)
    return daily.select(
        "product", "date", F.min("low").over(frame).alias("min_30d"), F.max("high").over(frame).alias("max_30d"),
        (F.sum("cents").over(frame).cast("double") / F.sum("n").over(frame) / 100).alias("avg_30d"),
    )
