"""Tables whose rows are costly are dealt over all cores, whatever their files."""

from sitegauge.operators import products as PD
from sitegauge.sources import derived as D


def test_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS p_partkey", "'n' || id AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 9 AS int) AS p_size", "1.0D AS p_retailprice")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get(D.INPUT_PARTITIONS)
    spark.conf.unset(D.INPUT_PARTITIONS)
    try:
        dealt = D.work_table(spark, str(tmp_path), "part")
        held = [len(p) for p in dealt.rdd.glom().collect()]
        products = PD.product_extract(D.product_pages(spark, str(tmp_path)))
        assert products.count() == 500
    finally:
        spark.conf.set(D.INPUT_PARTITIONS, before)
    assert len(held) == D.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert sum(held) == 500 and max(held) < 2 * 500 / len(held) + 2
