"""Keyed state of the streams against folds in order, for any cut into batches and over restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import accounts as A
from sitegauge.operators import prices as PR
from sitegauge.streaming import jobs as J

POINTS = "product long, store long, captured_at timestamp, price_cents long, l_orderkey long, l_linenumber int, price_text string"
START = dt.datetime(2024, 1, 1)


def feed(spark, folder, name, rows, columns):
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, columns):
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def points(n, seed=4):
    """Time order; product 7 has most of the points, and so do not all of them a readable price."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        price = draw.choice((5.0, 6.5, 7.0, 7.25))
        rows.append((7 if draw.random() < 0.7 else draw.randrange(40), 1, START + dt.timedelta(minutes=i), int(price * 100), i, 1, "n/a" if draw.random() < 0.1 else f"${price}"))
    return rows


def folded(rows, limits):
    last, out = {}, []
    for product, _, at, _, _, _, text in rows:
        if text == "n/a":
            continue
        price = float(text[1:])
        if product in last and last[product] != price:
            out.append((product, at, last[product], price, "drop" if price < last[product] else "increase", None))
        last[product] = price
        if (limits.get(product) or 0) > 0 and price <= limits[product]:
            out.append((product, at, None, price, "threshold", limits[product]))
    return sorted(out, key=repr)


def alerts(spark, path):
    names = ("product", "captured_at", "prev", "curr", "direction", "threshold")
    return sorted((tuple(r[n] for n in names) for r in spark.read.parquet(path).collect()), key=repr)


def test_price_alerts_over_batches_and_restarts(spark, tmp_path):
    rows = points(900)
    limits = {p: (5.0, 6.5, 0.0, None)[p % 4] for p in range(40)}
    data, thresholds = str(tmp_path / "points"), str(tmp_path / "limits")
    feed(spark, thresholds, "all", [(p, x) for p, x in limits.items()], "product long, threshold double")
    cuts = [0, 10, 300, 310, 640, 900]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        feed(spark, data, f"{i}", rows[a:b], POINTS)
        if i in (1, 4):  # two and three batches, with a restart between them
            found = J.price_changes(stream(spark, data, POINTS), str(tmp_path / "job"), thresholds=stream(spark, thresholds, "product long, threshold double"))
            assert alerts(spark, found) == folded(rows[:b], limits)
    # A later threshold replaces the one before from its batch on.
    feed(spark, thresholds, "later", [(7, 7.0), (3, None)], "product long, threshold double")
    more = [(p, 1, START + dt.timedelta(days=9, minutes=i), 1, i, 1, "$6.75") for i, p in enumerate((7, 7, 3))]
    feed(spark, data, "later", more, POINTS)
    J.price_changes(stream(spark, data, POINTS), str(tmp_path / "job"), thresholds=stream(spark, thresholds, "product long, threshold double"))
    late = [r for r in alerts(spark, found) if r[1] >= START + dt.timedelta(days=9) and r[4] == "threshold"]
    assert [(r[0], r[5]) for r in late] == [(7, 7.0), (7, 7.0)]


def test_stream_alerts_agree_with_the_batch_operator(spark, tmp_path):
    """The last change of every product is the batch alert of its last two readable prices."""
    rows = points(400, 8)
    feed(spark, str(tmp_path / "in"), "a", rows, POINTS)
    output = J.price_changes(stream(spark, str(tmp_path / "in"), POINTS), str(tmp_path / "job"))
    frame = spark.createDataFrame(rows, POINTS)
    newest = {r["product"]: r["at"] for r in frame.where("price_text <> 'n/a'").groupBy("product").agg(F.max("captured_at").alias("at")).collect()}
    got = {(r[0], r[2], r[3], r[4]) for r in alerts(spark, output) if r[1] == newest[r[0]]}
    assert got == {(r["product"], r["prev"], r["curr"], r["direction"]) for r in PR.price_change_alerts(frame).collect()}


def test_cost_of_a_batch_does_not_grow_with_known_products(spark, tmp_path):
    def second_batch(known):
        folder, job = str(tmp_path / f"in{known}"), str(tmp_path / f"job{known}")
        first = spark.range(known).selectExpr(
            "id AS product", "1L AS store", f"timestamp '{START}' AS captured_at", "100L AS price_cents", "1L AS l_orderkey", "1 AS l_linenumber", "'$1' AS price_text")
        first.coalesce(1).write.parquet(f"{folder}/a")
        J.price_changes(stream(spark, folder, POINTS), job)
        times = []
        for n in range(2):
            feed(spark, folder, f"b{n}", [(p, 1, START + dt.timedelta(days=n + 1), 200, 2, 1, f"${2 + n}") for p in range(500)], POINTS)
            started = dt.datetime.now()
            output = J.price_changes(stream(spark, folder, POINTS), job)
            times.append((dt.datetime.now() - started).total_seconds())
        assert spark.read.parquet(output).count() == 1000
        return min(times)

    few, many = second_batch(1_000), second_batch(100_000)
    assert many < 1.5 * few + 1, (few, many)


# --- captures --------------------------------------------------------------------------------

CAPTURES = "url string, fetched_at timestamp"


def kept(rows, hour=3600):
    last, out = {}, []
    for url, at in sorted(rows, key=lambda r: r[1]):
        if url not in last or (at - last[url]).total_seconds() >= hour:
            last[url] = at
            out.append((url, at))
    return sorted(out)


def dedup(spark, folder, job):
    J.use_rocksdb(spark)
    output = J.run_available(J.capture_dedup(stream(spark, folder, CAPTURES)), job, "update")
    return sorted((r["url"], r["fetched_at"]) for r in spark.read.parquet(output).collect())


def test_an_hour_runs_from_the_kept_capture(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 9, 59)), ("a", dt.datetime(2024, 1, 1, 10, 1)), ("a", dt.datetime(2024, 1, 1, 10, 59)), ("b", dt.datetime(2024, 1, 1, 10, 1))]
    feed(spark, str(tmp_path / "in"), "a", rows, CAPTURES)
    assert dedup(spark, str(tmp_path / "in"), str(tmp_path / "job")) == [rows[0], rows[2], rows[3]]


@pytest.mark.parametrize("cuts", [[0, 700], [0, 50, 51, 400, 700], [0, 350, 700]])
def test_captures_for_any_cut(spark, tmp_path, cuts):
    draw = random.Random(6)
    rows = sorted(((draw.choice("aaaaabc"), START + dt.timedelta(seconds=draw.randrange(3 * 86400))) for _ in range(700)), key=lambda r: r[1])
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        feed(spark, str(tmp_path / "in"), str(i), rows[a:b], CAPTURES)
        found = dedup(spark, str(tmp_path / "in"), str(tmp_path / "job"))  # every batch after a restart
        assert found == kept(rows[:b])


def test_state_of_captures_is_removed_by_timer(spark, tmp_path):
    folder, job = str(tmp_path / "in"), str(tmp_path / "job")

    def known():
        state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{job}/checkpoint")
        return sorted(r["key"]["url"] for r in state.collect())

    feed(spark, folder, "a", [("a", START), ("b", START + dt.timedelta(minutes=30))], CAPTURES)
    dedup(spark, folder, job)
    assert known() == ["a", "b"]
    feed(spark, folder, "b", [("c", START + dt.timedelta(hours=2, minutes=10))], CAPTURES)
    dedup(spark, folder, job)
    assert known() == ["b", "c"]  # the stream has passed the hour of a, not yet that of b


# --- subscriptions ---------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp, type string, customer string, email string, status string"


def test_subscription_changes_need_no_email(spark, tmp_path):
    accounts = spark.createDataFrame(
        [("a@x", False, None), ("b@x", True, "cus_b"), ("c@x", False, None), ("d@x", False, "cus_d")], "email string, premium boolean, customer_id string")
    log = [
        (1, 1, A.COMPLETED, "cus_a", "a@x", None), (2, 2, A.DELETED, "cus_b", None, None), (3, 3, A.UPDATED, "cus_a", None, "past_due"),
        (4, 4, A.UPDATED, "cus_a", None, "active"), (5, 5, A.COMPLETED, "cus_z", "z@x", None), (6, 6, A.UPDATED, "cus_y", None, "active"),
        (7, 7, A.COMPLETED, "cus_c", "c@x", None), (8, 8, A.DELETED, "cus_c", None, None), (9, 9, "invoice.paid", "cus_d", "d@x", None),
    ]
    rows = [(i, START + dt.timedelta(hours=h), *rest) for i, h, *rest in log]
    J.use_rocksdb(spark)
    for i, (a, b) in enumerate([(0, 3), (3, 7), (7, 9)]):
        feed(spark, str(tmp_path / "in"), str(i), rows[a:b], EVENTS)
        output = J.run_available(J.subscription_updates(stream(spark, str(tmp_path / "in"), EVENTS), accounts), str(tmp_path / "job"), "update")
        got = {r["email"]: (r["customer_id"], r["premium"], r["since"]) for r in J.latest_state(spark, output).collect()}
        batch = A.subscription_state(accounts, spark.createDataFrame(rows[:b], EVENTS)).collect()
        assert got == {r["email"]: (r["customer_id"], r["premium"], r["since"]) for r in batch if r["email"] in got}
    assert set(got) == {"a@x", "b@x", "c@x"}


def test_time_of_a_batch_is_not_one_call_a_product(spark, tmp_path):
    """Points and thresholds of 10,000 products take little more than those of 100; names are texts, one is null."""
    def seconds(n):
        folder, limits = str(tmp_path / f"in{n}"), str(tmp_path / f"limits{n}")
        name = "CASE WHEN id > 0 THEN 'p' || id END"
        spark.range(n).selectExpr(
            f"{name} AS product", "1L AS store", f"explode(array(timestamp '{START}', timestamp '{START + dt.timedelta(1)}')) AS captured_at", "100L AS price_cents", "1L AS l_orderkey", "1 AS l_linenumber",
        ).selectExpr("*", "'$' || day(captured_at) AS price_text").coalesce(1).write.parquet(f"{folder}/a")
        spark.range(n).selectExpr(f"{name} AS product", "1.5D AS threshold").coalesce(1).write.parquet(f"{limits}/a")
        columns = POINTS.replace("product long", "product string")
        started = dt.datetime.now()
        output = J.price_changes(stream(spark, folder, columns), str(tmp_path / f"job{n}"), thresholds=stream(spark, limits, "product string, threshold double"))
        took = (dt.datetime.now() - started).total_seconds()
        found = spark.read.parquet(output)
        assert {(r["direction"], r["prev"], r["curr"], r["threshold"]): r["count"] for r in found.groupBy("direction", "prev", "curr", "threshold").count().collect()} == {
            ("increase", 1.0, 2.0, None): n, ("threshold", None, 1.0, 1.5): n}
        assert found.where("product is null").count() == 2
        return took

    few, many = seconds(100), seconds(10_000)
    assert many < 2 * few + 5, (few, many)
