import random
from collections import defaultdict

from sitegauge.llm import exact_dedup, minhash

TEXT = " ".join(f"word{i}" for i in range(200))


def test_exact_odd_rows(odd_docs, no_docs):
    source = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    rows = exact_dedup.deduplicate(odd_docs).collect()
    assert len(rows) == len(source)
    groups = defaultdict(list)
    for i, t in source:
        groups[t].append(i)
    by_digest = defaultdict(list)
    for r in rows:
        by_digest[r["text_sha256"]].append(r)
    want = sorted((len(ids), max((i for i in ids if i is not None), default=-1)) for ids in groups.values())
    assert sorted((rs[0]["group_size"], -1 if rs[0]["keep_id"] is None else rs[0]["keep_id"]) for rs in by_digest.values()) == want
    assert all(sum(r["kept"] for r in rs) == 1 and len(rs) == rs[0]["group_size"] for rs in by_digest.values())
    kept = exact_dedup.kept_rows(odd_docs.withColumn("__key", odd_docs.doc_id))
    assert kept.columns == [*odd_docs.columns, "__key"]
    kept = exact_dedup.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(groups)
    assert exact_dedup.deduplicate(no_docs).count() == 0 and exact_dedup.kept_rows(no_docs).count() == 0


def jaccard_classes(texts, similar=0.8):
    """Brute force: least id of each connected component."""
    runs = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        runs[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(runs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 0.8 * len(runs[a]) <= len(runs[b]) <= 1.25 * len(runs[a]) and len(runs[a] & runs[b]) >= similar * len(runs[a] | runs[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_classes_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == jaccard_classes({r["doc_id"]: r["text"] for r in docs.collect()})


def test_chain_of_near_copies_is_one_class(spark):
    """Each text differs from the next by two words; far ends are no longer similar."""
    words, rows = TEXT.split(), []
    for i in range(60):
        words[3 * i + 1] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"other text number {i} " + " ".join(f"u{i}x{k}" for k in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == jaccard_classes(dict(rows)) and len({got[i] for i in range(60)}) == 1


def test_copies_with_a_repeated_line(spark):
    """Plain similarity 0.92, weighted 0.25: one copy repeats a line many times."""
    rows = []
    for i in range(12):
        text = " ".join(f"t{i}w{k}" for k in range(104))
        rows += [(2 * i, text), (2 * i + 1, text + f" menu{i} home about shop contact" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == jaccard_classes(dict(rows)) and got[23] == 22
    assert minhash.kept_rows(docs).count() == 12


def test_link_at_the_edges_of_a_bucket(spark):
    """h-y and x-y are 0.8, h-x is 0.6; h is the hub, and neither x nor y may miss the other."""
    words = TEXT.split()[:14]
    texts = spark.createDataFrame([("h", " ".join(words[:12])), ("x", " ".join(words[2:])), ("y", " ".join(words))], "node string, words string")
    bands = spark.createDataFrame([(1, "h", 9), (1, "x", 3), (1, "y", 3)], "key long, node string, n long")
    labels = {r["node"]: r["label"] for r in minhash.labels_of(bands, texts, 0.8).collect()}
    assert labels.get("h", "h") == labels["x"] == labels["y"] == "h"


def thue_morse(letters, order):
    a, b = letters
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_words_with_equal_polynomial_codes(spark):
    """Such words are different words: texts of them are no near copies."""
    a, b = thue_morse("ab", 10)
    rows = [(1, " ".join([a] * 3 + ["x", "y"])), (2, " ".join([b] * 3 + ["x", "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in minhash.near_duplicates(docs).collect()} == {1, 2}


def test_similar_texts_share_one_of_their_rarest_runs():
    import numpy as np

    draw = np.random.default_rng(4)
    checked = [0, 0]
    for trial in range(400):
        often = draw.integers(1, 9, 400)
        n = int(draw.integers(1, 60))
        base = draw.choice(400, n, replace=False)
        a = {int(k): float(draw.integers(1, 1 + trial % 6 + 1)) for k in base}
        b = {k: w + float(draw.integers(0, 2)) for k, w in a.items() if draw.random() > 0.1} | {int(k): 1.0 for k in draw.choice(400, int(draw.integers(0, n // 6 + 1)))}
        if not b:
            continue
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        weighted, plain = minhash.similarities(*arrays)
        sets = []
        for runs, weights in arrays:
            kept = minhash.rarest_runs(np.zeros(len(runs), int), runs, weights, 1, often[runs.astype(int)], 0.8)
            sets.append(set(runs[kept].tolist()))
        if max(weighted, plain) >= 0.8:
            checked[0] += 1
            assert sets[0] & sets[1]
        checked[1] += 1
    assert checked[0] > 50


def test_bound_of_the_first_common_run_holds_for_similar_texts(spark):
    import numpy as np

    draw, rows, similar = np.random.default_rng(6), [], []
    for trial in range(300):
        often = np.where(np.arange(600) < 300, 9, draw.integers(1, 9, 600))
        base = draw.choice(300, int(draw.integers(2, 120)), replace=False)
        a = {int(k): float(draw.integers(1, 2 + trial % 4)) for k in base}
        b = {k: w for k, w in a.items() if draw.random() > trial % 5 * 0.04} | {int(k): 1.0 for k in draw.choice(600, trial % 3 * len(base) // 5)}
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        found = [minhash.places(np.zeros(len(r), int), r, w, 1, often[r.astype(int)]) for r, w in arrays]
        both = np.intersect1d(arrays[0][0], arrays[1][0])
        if len(both):
            first = min(both.tolist(), key=lambda k: (often[k], k))
            rows.append([float(f[i][r == first][0]) for (r, _), f in zip(arrays, found, strict=True) for i in range(4)])
            similar.append(max(minhash.similarities(*arrays)) >= 0.8)
    names = [of + c for of in ("", "hub_") for c in ("n", "weight", "place", "before")]
    got = [r["may"] for r in spark.createDataFrame(rows, names).coalesce(1).select(minhash.may_be_similar(0.8).alias("may")).collect()]
    assert all(may for may, s in zip(got, similar, strict=True) if s)
    assert sum(similar) > 50 and sum(not may for may in got) > 5


def test_edited_copies_of_one_text_are_compared_less_than_pairwise(spark, monkeypatch):
    """150 copies of one text with edits of their own: 0.62 to each other, and some near copies among them."""
    rows = []
    for i in range(150):
        words = [f"shared{k}" for k in range(300)]
        for k in range(7):
            words[(i * 7 + k * 43) % 300] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 150, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, plain = [], minhash.compared
    monkeypatch.setattr(minhash, "compared", lambda pairs, words: seen.append(pairs.count()) or plain(pairs, words))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == jaccard_classes(dict(rows))
    assert sum(seen) < 10 * len(rows), seen


def test_family_with_a_common_passage_needs_few_comparisons(spark, monkeypatch):
    """300 texts at about 0.7 to each other through one passage, with near copies of some among them."""
    passage = " ".join(f"shared{k}" for k in range(174))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(66))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, plain = [], minhash.compared
    monkeypatch.setattr(minhash, "compared", lambda pairs, words: seen.append(pairs.count()) or plain(pairs, words))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == jaccard_classes(dict(rows))
    assert sum(seen) < 30 * len(rows), seen


def test_near_odd_rows(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_class = defaultdict(list)
    for r in rows:
        by_class[r["class_id"]].append(r)
    assert all(sum(r["kept"] for r in rs) == 1 for rs in by_class.values())
    assert {r["doc_id"] for r in by_class[2]} == {2, 3, 4, None}  # without words
    assert {r["doc_id"] for r in by_class[1]} == {1, 6} and {r["doc_id"] for r in by_class[8]} == {8, 9}
    kept = minhash.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(by_class)
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.kept_rows(no_docs).count() == 0


def test_registers_estimate_probability_jaccard():
    import numpy as np

    draw = np.random.default_rng(1)
    a = {int(k): float(w) for k, w in zip(draw.integers(1, 1 << 40, 80), draw.integers(1, 6, 80))}
    b = {k: w * (2 if i % 3 == 0 else 1) for i, (k, w) in enumerate(a.items()) if i >= 12}
    both = sorted(set(a) | set(b))
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in both) for i in both if i in a and i in b)
    arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    assert abs(minhash.similarities(*arrays)[0] - exact) < 1e-12
    m = 4000
    s = [minhash.signatures(np.zeros(len(r), int), r, w, 1, m) for r, w in arrays]
    assert abs((s[0] == s[1]).mean() - exact) < 0.03


def test_components_stop_at_stars(spark, monkeypatch):
    """Labels are the least nodes of the components; links that are stars already take no round."""
    tables = []

    def written(df):
        tables.append(df)
        return df.localCheckpoint()

    monkeypatch.setattr(minhash, "written", written)
    monkeypatch.setattr(minhash, "discard", lambda *_: None)
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 30)]
    loose = [(100 + draw.randrange(60), 100 + draw.randrange(60)) for _ in range(40)]
    label = {n: n for link in chain + loose for n in link}
    for _ in label:
        for u, v in chain + loose:
            label[u] = label[v] = min(label[u], label[v])
    linked = {n for u, v in chain + loose if u != v for n in (u, v)}
    found = minhash.components(spark.createDataFrame(chain + loose, "u int, v int")).collect()
    assert {(r["node"], r["label"]) for r in found} == {(n, label[n]) for n in linked if label[n] != n}
    tables.clear()
    found = minhash.components(spark.createDataFrame([(1, 5), (5, 1), (1, 7), (2, 9), (3, 3)], "u int, v int")).collect()
    assert sorted((r["node"], r["label"]) for r in found) == [(5, 1), (7, 1), (9, 2)]
    assert len(tables) == 1
    assert minhash.components(spark.createDataFrame([], "u int, v int")).isEmpty()
