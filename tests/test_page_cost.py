"""Steps of the page audit that are paid for every page or token."""

import re

from pyspark.sql import functions as F

from sitegauge.functions import html as H
from sitegauge.functions import text as T
from sitegauge.sources import derived as D

COMPILED = 8000


def test_inserted_markup_is_worked_out_in_compiled_methods(spark, tmp_path):
    rows = [(k, f"https://example.com/{k}", f"<html lang='en'><head><title>t</title></head><body><article>{k}</article></body></html>") for k in range(1, 400)]
    rows += [(None, "u", "<head></head><article>"), (400, None, "<head></head><article>"), (401, "u", None), (401, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages, plain = D.pages_aug(spark, str(tmp_path)), D.derive(D.table(spark, str(tmp_path), "pages"), D.PAGES_AUG)
    assert pages.dtypes == plain.dtypes
    assert pages.exceptAll(plain).isEmpty() and plain.exceptAll(pages).isEmpty()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(D.pages_aug(spark, str(tmp_path))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < COMPILED, sizes


def test_kinds_and_names_of_odd_tokens(spark):
    html = "a &amp; b<!DOCTYPE x><!-- c --><?xml y?><P Class=x>1 < 2 <3 </P ><br/><SCRIPT>if (a<b) {}</SCRIPT></3><"
    found = spark.createDataFrame([(html,)], "html string").select(F.explode(H.tokens(F.col("html"))).alias("t")).select("t.*").orderBy("pos").collect()
    assert [(r["kind"], r["tag"], r["raw"]) for r in found] == [
        ("text", None, "a & b"), ("decl", None, "<!DOCTYPE x>"), ("comment", None, "<!-- c -->"), ("decl", None, "<?xml y?>"),
        ("open", "p", "<P Class=x>"), ("text", None, "1 < 2 <3 "), ("close", "p", "</P >"), ("open", "br", "<br/>"),
        ("open", "script", "<SCRIPT>if (a<b) {}</SCRIPT>"), ("text", None, "/3><"),
    ]


def test_syllables_of_all_words_equal_the_sum_by_word(spark):
    texts = ["", "a the of", "rhythm nth created boxes yes yyy ed", "Beautiful queue hmm eyed early tables agreed Noël"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("words", T.letter_words(F.col("text")))
    sums = F.aggregate(F.transform("words", T.syllables), F.lit(0), lambda a, n: a + n)
    read = rows.select(T.total_syllables(F.col("words")).alias("all"), sums.alias("sum"))
    assert [(r["all"], r["sum"]) for r in read.collect() if r["all"] != r["sum"]] == []
    plan = spark._jvm.PythonSQLUtils.explainString(rows.select(T.total_syllables(F.col("words")))._jdf.queryExecution(), "extended")
    assert plan.split("== Physical Plan ==")[1].count("array_join") <= 2  # the long words are joined once, not at every use
