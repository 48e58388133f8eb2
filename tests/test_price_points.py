import re

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import prices as PR
from sitegauge.sources import derived as D

#: Bytecode that the JVM compiles in one method at most (its HugeMethodLimit).
COMPILED = 8000


@pytest.fixture()
def points_dir(spark, tmp_path):
    rows = [(k, k % 3, k % 2, n, q, float(p)) for k in range(1, 40) for n, q, p in ((1, 1.0, 100 * k), (2, 41.0, 7.5 * k), (3, 0.0, 5), (4, 3.0, 1234567 * k))]
    rows += [(None, 1, 1, 1, 1.0, 5.0), (5, None, 1, None, 2.0, 5.0), (6, 1, None, 1, None, 5.0), (6, 1, 1, 2, 2.0, None)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    frame.withColumn("l_shipdate", F.expr("timestamp '2024-01-01 00:00:00' + interval 1 day * l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_price_points_equal_their_expressions(spark, points_dir):
    points, plain = D.price_points(spark, points_dir), D.derive(D.table(spark, points_dir, "lineitem"), D.PRICE_POINTS)
    assert points.dtypes == plain.dtypes
    assert points.exceptAll(plain).isEmpty() and plain.exceptAll(points).isEmpty()


@pytest.mark.parametrize("build", [PR.price_series, PR.price_history, PR.price_report_products, PR.price_report_summary])
def test_price_points_run_in_methods_that_are_compiled(spark, points_dir, build):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = build(D.price_points(spark, points_dir))._jdf.queryExecution()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < COMPILED, sizes
