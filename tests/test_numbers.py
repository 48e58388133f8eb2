"""Rounding as the comparison SQL does it: scaled, then half away from zero."""

import datetime as dt

from pyspark.sql import functions as F

from sitegauge.functions import text as T
from sitegauge.functions.numbers import rounded
from sitegauge.operators import prices as PR


def test_grade_is_rounded_as_scaled(spark):
    row = spark.createDataFrame([("a " * 296,)], "text string").select(T.readability(F.col("text")).alias("r")).select("r.*").first()
    assert (row["word_count"], row["syllable_count"], row["grade"]) == (296, 296, 111.7)  # 111.64999999999999


def test_percent_is_rounded_as_scaled(spark):
    day = dt.datetime(2024, 1, 1)
    pairs = [("$1460", "$1840.33", 26.1), ("$2040", "$1451.46", 28.9), ("$1280", "$920.96", 28.1)]  # 26.049999999999997, ...
    rows = [(p, 1, day + dt.timedelta(i), 1, 1, i, t) for p, pair in enumerate(pairs) for i, t in enumerate(pair[:2])]
    points = spark.createDataFrame(rows, "product long, store long, captured_at timestamp, price_cents long, l_orderkey long, l_linenumber int, price_text string")
    want = {p: pair[2] for p, pair in enumerate(pairs)}
    assert {r["product"]: r["pct"] for r in PR.price_change_alerts(points).collect()} == want
    assert {r["product"]: r["change_pct"] for r in PR.price_report_alerts(points).collect()} == want
    assert {r["product"]: r["pct"] for r in PR.price_drop_strict(points).collect()} == {1: 28.9, 2: 28.1}


def test_sign_is_kept(spark):
    row = spark.range(1).select(*[rounded(F.lit(x), 1).alias(n) for n, x in (("zero", -0.04), ("half", -0.25), ("up", 0.04))], rounded(F.lit(None).cast("double"), 1).alias("null")).first()
    assert [str(row[c]) for c in ("zero", "half", "up", "null")] == ["-0.0", "-0.3", "0.0", "None"]
