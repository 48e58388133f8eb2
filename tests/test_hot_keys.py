"""Joins in which one key, or none, holds nine tenths of the rows are split at run time."""

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import accounts as A
from sitegauge.operators import prices as PR
from sitegauge.operators import url_ops as U

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}
ROWS = 60_000


@pytest.fixture
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def key(hot):
    return F.when(F.col("id") % 10 > 0, F.lit(hot)).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))


def final_plan(df):
    assert df.count() > 0
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_product(low):
    points = low.range(0, ROWS, 1, 8).select(
        key("hot").alias("product"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("store"), F.lit("$5").alias("price_text"),
        F.timestamp_seconds("id").alias("captured_at"), F.lit("USD").alias("currency"), F.col("id").alias("point_id"))
    assert "skew=true" in final_plan(PR.price_series(points))
    assert "skew=true" in final_plan(PR.price_report_products(points, ("captured_at", "point_id")))


def test_hot_host_and_refused_urls(low):
    urls = low.range(0, ROWS, 1, 8).select(F.concat(F.lit("http://"), key("hot.example"), F.lit("/"), F.col("id").cast("string")).alias("url"))
    dns = urls.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.lit("93.184.216.34").alias("address"))
    assert "skew=true" in final_plan(U.address_admission(urls, dns))
    refused = low.range(0, ROWS, 1, 8).select(F.concat(F.lit("ftp://x/"), F.col("id").cast("string")).alias("url"))
    spread = U.address_admission(refused, dns)
    assert spread.where("ok").count() == 0 and spread.count() == ROWS


def test_accounts_without_customer_are_dealt_out(low):
    accounts = low.range(0, ROWS, 1, 8).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("email"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("customer_id"), F.lit(False).alias("premium"))
    events = low.createDataFrame([], "event_id long, ts timestamp, type string, email string, customer string, status string")
    state = A.subscription_state(accounts, events)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in plan and "xxhash64(email" in plan
    assert state.count() == ROWS
