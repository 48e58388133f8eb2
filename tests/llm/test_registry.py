import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from compare import connect, differences  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sitegauge.llm.registry import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf_dir):
    assert differences(spark, connect(sf_dir), QUERIES[name], ORACLE[name], sf_dir) is None


def test_pipeline_against_single_stages(spark, sf_dir):
    """Every stage keeps what its operator says of the rows before it, and the last packs exactly those."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        before, after = {tuple(r) for r in docs.collect()}, [tuple(r) for r in out.collect()]
        assert set(after) <= before and len(set(after)) == len(after) and len(after) > 0.7 * len(before), name
        docs = spark.createDataFrame(after, out.schema)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
        stage(spark, odd_docs, sf_dir).count()
