import hashlib
import math
from collections import Counter

from sitegauge.llm.sharding import DRAW_PRIME, ROUND_FACTORS, SHARD_STEP, descend, key_digits, key_of, shard_documents, topology


def place(key, tree):
    digest = hashlib.md5(key.encode()).hexdigest()
    best = None
    for leaf in tree:
        mixed = (leaf.shard + 1) * SHARD_STEP
        for i, factor in enumerate(ROUND_FACTORS):
            mixed = (mixed ^ int(digest[7 * i : 7 * i + 7], 16)) * factor % DRAW_PRIME
        draw = (-math.log((mixed + 0.5) / DRAW_PRIME) / leaf.weight, leaf.shard)
        best = draw if best is None else min(best, draw)
    return best[1]


def placed(spark, tree, n=4000):
    frame = spark.range(n).select(key_digits(key_of("id")).alias("d"), "id").select("id", descend("d", tree).alias("at"))
    return {r["id"]: r["at"]["shard"] for r in frame.collect()}


def test_descent_is_the_least_draw(spark):
    tree = topology(23, weights={3: 2.5, 7: 0.5})
    assert placed(spark, tree, 300) == {i: place(str(i), tree) for i in range(300)}


def test_a_new_shard_takes_rows_only_into_itself_and_shares_are_even(spark):
    for n in (15, 16, 40):
        old, new = placed(spark, topology(n)), placed(spark, topology(n + 1))
        moved = [i for i in old if old[i] != new[i]]
        assert {new[i] for i in moved} == {n} and len(moved) < 2 * len(old) / n
        counts = Counter(old.values())
        assert max(abs(counts[s] - len(old) / n) for s in range(n)) < 5 * math.sqrt(len(old) / n)


def test_a_heavier_shard_only_gains(spark):
    old, new = placed(spark, topology(20)), placed(spark, topology(20, weights={5: 3.0}))
    assert {new[i] for i in old if old[i] != new[i]} == {5}


def test_odd_rows(odd_docs, no_docs):
    rows = shard_documents(odd_docs, topology(3), topology(4)).collect()
    assert len(rows) == odd_docs.count()
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (2, 3)} == {(16, 0)}
    assert shard_documents(no_docs, topology(3)).count() == 0
