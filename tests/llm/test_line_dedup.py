import hashlib

import pytest
from pyspark.sql import functions as F

from sitegauge.llm.line_dedup import LineIndex, drop_common_lines

BLANKS = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_docs, least_chars):
    found = {}
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            found.setdefault(key(line), set()).add(n)
    common = {k for k, docs in found.items() if len(docs) >= least_docs and len(k) >= least_chars}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, *args, **kwargs):
    rows = drop_common_lines(df, *args, **kwargs).withColumn("kept", F.sha2("kept_text", 256)).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows), key=repr)


ROWS = (
    [(i, f"own line {i}\n\t COOKIES Notice \r\nÉtat\n{'menu' if i % 2 else 'Menu '}\n\nend {i % 4}") for i in range(12)]
    + [(20, None), (21, ""), (22, "\n\n"), (23, "menu"), (24, "cookies notice\ncookies notice"), (24, "cookies notice\ncookies notice")]
    + [(None, "menu\nlost"), (None, None), (25, "état\nETAT"), (26, "x y\nK\nmenu ")]
    + [(30, "\n".join(f"line {i % 7000}" for i in range(9000)) + "\nmenu"), (31, "word " * 60_000)]
    + [(i, "a copy of one text\nmenu") for i in range(40, 80)]
)


@pytest.mark.parametrize("least_docs,least_chars,batches,fanout", [(10, 1, 4, 2), (3, 1, 5, 3), (4, 5, 1, 2), (10, 0, 3, 2)])
def test_against_brute_force(spark, least_docs, least_chars, batches, fanout):
    clash = [f"'x' AS {c}" for c in ("line", "lines", "docs", "at", "row", "batch", "hashes", "hot", "dropped", "kept_text")]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *clash).repartition(5)
    assert run(df, least_docs, least_chars, batches=batches, fanout=fanout) == brute(ROWS, least_docs, least_chars)


def test_no_rows(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string"), 10) == []


def test_levels_of_runs(spark):
    """Two runs of a level become one of the next, and counts are summed over all of them."""
    index = LineIndex(spark, 3, fanout=2, buckets=2)
    batches = [["a", "b"], ["a", "c"], ["b", "c"], ["a", "a", "c"], ["c", "b"]]
    shapes = []
    for batch in batches:
        index.add(spark.createDataFrame([([x.encode()],) for x in batch], "lines array<binary>"))
        shapes.append({level: len(names) for level, names in index.levels.items() if names})
    assert shapes == [{0: 1}, {1: 1}, {1: 1, 0: 1}, {2: 1}, {2: 1, 0: 1}]
    assert {r["line"].decode() if isinstance(r["line"], str) else bytes(r["line"]).decode() for r in index.frequent().collect()} == {"a", "b", "c"}


def test_native_and_runs_are_joined_in_place(spark):
    """No Python worker, and the side of a run has no exchange in the anti-join."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = drop_common_lines(df, 10)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "PythonRDD"))
    index = LineIndex(spark, 1, buckets=4)
    index.add(spark.createDataFrame([([b"a"],)], "lines array<binary>"))
    index.frequent()
    (settled,) = index.settled
    batch = spark.range(100).select(F.encode(F.col("id").cast("string"), "utf-8").alias("line")).repartition(4, "line")
    anti = batch.join(spark.table(settled).hint("merge"), "line", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert anti.count("Exchange hashpartitioning") == 1
