import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitegauge.llm.collocations import _by_routes, collocations, frequent_phrases, three_way

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, absorbed=100):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        scored = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(h) > len(g) and b >= least and 100 * b >= absorbed * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in f.items() if b * 100 >= absorbed * a):
                continue
            score, k = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]], totals[lang], score))
        for rank, (_, _, phrase, *numbers) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), *numbers))
    return sorted(out)


def texts(seed=1):
    draw = random.Random(seed)
    vocabulary = ["red", "Red", "green", "blue", "Äpfel", "of", "the", "a", "in a", "x", "y", "\x00z"]
    rows = [(draw.choice(("en", "de", None)), "".join(draw.choice(vocabulary) + draw.choice((" ", " ", " \t ", ", ", "\n")) for _ in range(draw.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "one common passage of many words here and there")] * 40 + [("de", None), ("de", ""), (None, " \t "), ("fr", "a a a a a a a a"), ("xx", "...")]
    return rows + [("en", "the red apple " * 4000), ("en", "the" * 30_000)]


@pytest.mark.parametrize("routes,least,absorbed", [(1, 5, 100), (200, 5, 100), (10**9, 8, 90)])  # of 10**9 routes all are crowded
def test_against_brute_force(spark, routes, least, absorbed):
    """No crowded route, some, and all of them crowded down to the last word; blocks merged a few at a time."""
    rows = texts()
    clash = [f"'x' AS {c}" for c in ("phrase", "k", "exact", "route", "phrases", "counts", "total", "f", "n", "words", "single")]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", *clash).repartition(3)
    phrases, languages = frequent_phrases(df, least, routes=routes, chunk=40)
    got = collocations(phrases, languages, least, 50, absorbed).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == brute(rows, least, 50, absorbed)


@pytest.mark.parametrize("routes,batch", [(1, 3), (20, 7), (10**9, 50)])
def test_routes_go_on_in_the_next_batch(spark, routes, batch):
    """A task merges the blocks of a route that came so far and goes on with later batches; no crowded route, some, and all."""
    rows, name = texts(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        phrases, languages = frequent_phrases(spark.createDataFrame(rows, "lang string, text string").repartition(3), 5, routes=routes, chunk=40)
        got = collocations(phrases, languages, 5, 50).collect()
    finally:
        spark.conf.set(name, kept)
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == brute(rows, 5, 50)


def test_no_rows(spark):
    phrases, languages = frequent_phrases(spark.createDataFrame([], "lang string, text string"), 2)
    assert collocations(phrases, languages, 2, 10).count() == 0


def test_products_beyond_64_bits(spark):
    """The score is exact where numerator and denominator pass 64 bits; ties go to the earlier cut."""
    n, a, l, r = 9_007_199_254_740_993, 3_000_000_019, 5_000_000_029, 4_000_000_007
    phrases = spark.createDataFrame([("en", "p", 1, l), ("en", "q", 1, r), ("en", "p q", 2, a)], "lang string, phrase string, n_words int, f long")
    (row,) = collocations(phrases, spark.createDataFrame([("en", n)], "lang string, n long"), 2, 10).collect()
    assert row["score"] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("least", [1, 4, 50])
def test_partitions_of_equal_words(least):
    draw = np.random.default_rng(least)
    words = [draw.integers(-1, 6, 4000) for _ in range(3)]
    for a, b in zip(words, words[1:]):
        b[a < 0] = -1
    weights, group = draw.integers(1, 4, 4000), np.sort(draw.integers(0, 9, 4000))
    want = Counter()
    for i in range(4000):
        for d in range(3):
            if words[d][i] < 0:
                break
            want[(group[i], *(int(w[i]) for w in words[: d + 1]))] += int(weights[i])
    got = {}
    for depth, ended, first, sums in three_way(words, weights, np.arange(4000), np.unique(group, return_counts=True)[1], least):
        if not ended:
            got |= {(group[p], *(int(w[p]) for w in words[: depth + 1])): int(n) for p, n in zip(first, sums)}
    assert got == {k: n for k, n in want.items() if n >= least}


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_routes_are_sorted_whole(most):
    """Pieces are all rows in order, cut between routes only, with at most the given phrases unless one route has more."""
    draw = random.Random(most)
    sizes = [(route, draw.randint(1, 5)) for route in sorted(draw.randint(0, 30) for _ in range(200))]
    names = ["lang", "k", "exact", "route", "counts"]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*(("en", 2, False, r, [1] * n) for r, n in sizes))], names)
    parts = list(_by_routes(batch, most))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    routes = [sorted(set(p.column("route").to_pylist())) for p in parts]
    assert sum(routes, []) == sorted({r for r, _ in sizes})
    assert all(len(r) == 1 or len(p.column("counts").flatten()) <= most for r, p in zip(routes, parts))
    assert list(_by_routes(batch.slice(0, 0), most)) == []
