"""Exports of JSON documents of any form, and batches of reports."""

import csv
import io
import json

from sitegauge.operators import routing as R
from sitegauge.sources import files as FS

BODIES = {
    1: {"total": 2, "results": [{"url": "u", "text": 'say "hi",\nok', "n": 1}, {"url": None, "n": 2.5}]},
    2: [{"b": 1, "a": [1, {"x": "y"}]}, {"a": "z", "c": "later"}, 7, "s", [{"no": 1}]],
    3: {"x": [{"k": "1"}, 3], "y": "s", "z": [{"k": "2"}]}, 4: {"results": []}, 5: [], 6: {}, 7: "text", 8: {"a": {"b": [{"k": 1}]}},
}


def rows_of(data):
    if isinstance(data, dict) and "results" in data:
        data = data["results"]
    if isinstance(data, dict):
        data = [item for value in data.values() if isinstance(value, list) for item in value]
    return [r for r in data if isinstance(r, dict)] if isinstance(data, list) else []


def cell(value):
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def test_rows_and_csv_of_any_document(spark):
    frame = spark.createDataFrame([(i, json.dumps(b)) for i, b in BODIES.items()] + [(20, "[{broken"), (21, None), (22, "")], "doc_id long, body string")
    got = {}
    for r in FS.document_rows(frame).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = (r["fields"], r["header"])
    want = {}
    for i, body in BODIES.items():
        for pos, row in enumerate(rows_of(body)):
            want.setdefault(i, {})[pos] = ({k: cell(v) for k, v in row.items()}, list(rows_of(body)[0]))
    assert got == want
    texts = {r["doc_id"]: (r["n_rows"], r["csv"]) for r in FS.documents_csv(frame).collect()}
    for i, (n, text) in texts.items():
        rows = rows_of(BODIES[i])
        out = io.StringIO()
        writer = csv.DictWriter(out, list(rows[0]), extrasaction="ignore")
        writer.writeheader()
        writer.writerows({k: cell(v) for k, v in row.items()} for row in rows)
        assert (n, text) == (len(rows), out.getvalue())
    assert set(texts) == set(want)


def test_export_has_the_header_of_the_first_row(spark, tmp_path):
    frame = spark.createDataFrame([(1, json.dumps(BODIES[1]))], "doc_id long, body string")
    assert FS.export_documents(frame, str(tmp_path / "out")) == ["url", "text", "n"]
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert back.columns == ["url", "text", "n"]
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, [("u", 'say "hi",\nok', "1"), (None, None, "2.5")]))
    assert FS.export_documents(frame.where("false"), str(tmp_path / "none")) == []


def test_batches_are_full_but_for_the_last(spark):
    rows = spark.range(1234).selectExpr("id * 7 % 5000 AS page_id").repartition(7)
    numbered = R.batch_numbers(rows, ("page_id",), 50).collect()
    ids = sorted(r["page_id"] for r in numbered)
    assert {r["page_id"]: r["batch"] for r in numbered} == {p: i // 50 for i, p in enumerate(ids)}
    captures = spark.createDataFrame(
        [(i, f"https://a.com/{i}", 404 if i % 3 == 0 else 200, "text/html", None, "<title>t</title>") for i in range(120)],
        "page_id long, url string, status int, content_type string, refusal string, html string")
    found = {r["batch"]: (r["total"], json.loads(r["results"])) for r in R.batch_documents(captures, 50).collect()}
    assert [found[b][0] for b in range(3)] == [50, 50, 20]
    assert [x["url"] for x in found[1][1]] == [f"https://a.com/{i}" for i in range(50, 100)]
    assert found[0][1][0] == {"url": "https://a.com/0", "status": "error", "error": "HTTP 404"}
    assert found[0][1][1]["status"] == "ok" and found[0][1][1]["audit"]["grade"] in "ABCDEF"
