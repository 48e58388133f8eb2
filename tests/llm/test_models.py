import numpy as np
import pytest

from sitegauge.llm import language_id, quality
from sitegauge.llm.queries_language_id import op4_subword_language_id
from sitegauge.llm.queries_quality import op6_rule_ensemble_quality

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    rows = op4_subword_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.95
    assert rows.score.between(0, 1).all() and rows.rejected.mean() < 0.01


@pytest.fixture(scope="module")
def small_model():
    texts = ["the cat and the dog with them", "der hund und die katze mit ihnen"] * 30
    return language_id.fit(texts, ["en", "de"] * 30)


def test_languages_of_odd_rows(odd_docs, no_docs, small_model):
    found = language_id.identify(odd_docs, small_model)
    assert set(found.columns) == {*odd_docs.columns, "lang_pred", "score", "rejected"}
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in rows if r["doc_id"] in (2, 3, 4, 7)} == {("und", 0.0, True)}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 5)} <= {"en", "de"}
    assert language_id.identify(no_docs, small_model).count() == 0


def test_nothing_to_learn_from(odd_docs, no_docs):
    model = language_id.fit(*language_id.sample(no_docs, "doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, model).collect()} == {"und"}


def test_held_out_quality(spark):
    rows = op6_rule_ensemble_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95 and rows.score.between(0, 1).all()


def test_compiled_rules_give_the_model_s_score(odd_docs):
    model = quality.Model(0.5, [((("n_words", "<=", 3.0), ("digits", ">", 0.1)), 2.0), ((("capitals", ">", 0.0),), -1.5)])
    for r in quality.rate(odd_docs, model).collect():
        text = r["text"] or ""
        digits = sum(c.isdigit() for c in text) / len(text) if text else 0
        total = 0.5 + 2.0 * (len(text.split()) <= 3 and digits > 0.1) - 1.5 * any(c.isupper() for c in text)
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_of_odd_rows(odd_docs, no_docs):
    model = quality.Model(0.5, [((("n_words", ">", 3.0),), -2.0)])
    rated = quality.rate(odd_docs, model)
    assert set(rated.columns) == set(odd_docs.columns)
    rows = rated.collect()
    assert {r["predicted"] for r in rows if r["doc_id"] in (2, 3, 8)} == {1} and {r["predicted"] for r in rows if r["doc_id"] in (1, 5)} == {0}
    assert quality.rate(no_docs, model).count() == 0


def test_fit_without_two_classes():
    assert quality.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).rules == []
    assert quality.fit(np.ones((5, 2)), np.ones(5), ["a", "b"]).rules == []
