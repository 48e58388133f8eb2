import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from sitegauge.llm.common import by_slices
from sitegauge.llm.packing import best_fit, pack, pack_documents, vocabulary
from sitegauge.llm.pieces import encode_documents, pieces
from sitegauge.llm.token_counts import Machine, count_tokens, counts
from sitegauge.llm.words import BLOCK, Words

WORD_PATH, PIECE_PATH = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab'rvlestmd  '!?12é́ΣİßǅI\x1c\x1e\x85​ 中٣½²'\t"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_PATH)


def morse_texts():
    """Pairs of words whose polynomial codes are equal, alone and together."""
    out = []
    for letters, order in (("ab", 11), ("th", 10)):
        a, b = letters
        for _ in range(order):
            a, b = a + b, b + a
        out += [a, b, f"{a} {b} {a}", f"{b} {a}"]
    return out


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(4)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 90))) for _ in range(600)]
    return [*texts, "a<|endoftext|>b <|startoftext|>", "<|endoftext", "", "   ", "x" * 3000, "it's we'll THEY'RE don't 've'll'r e " * 30, "ab" * BLOCK, *morse_texts()]


def test_machines_count_what_the_library_counts(library, odd_texts):
    want = [len(e.ids) for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert counts(odd_texts, WORD_PATH).tolist() == want


def test_a_machine_that_starts_anew_counts_the_same(library, odd_texts):
    small = Machine(WORD_PATH, most_cells=1)
    words = Words(odd_texts)
    index, _ = words.distinct()
    once = small.count(words.data, words.start[index], words.length[index])
    assert (small.count(words.data, words.start[index], words.length[index]) == once).all()


def test_word_ids_are_the_library_s(library, odd_texts):
    flat, upto = vocabulary(WORD_PATH).ids(odd_texts)
    want = [e.ids for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert flat.tolist() == sum(want, []) and upto.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_counts_of_odd_rows(odd_docs, no_docs, library):
    rows = count_tokens(odd_docs, WORD_PATH, 2048).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048) for r in odd_docs.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert count_tokens(no_docs, WORD_PATH, 2048).count() == 0


def test_pieces_are_those_of_a_unigram_model():
    model = pieces(PIECE_PATH)
    other = Tokenizer(models.Unigram([(n, float(model.score[i])) for i, n in enumerate(model.names)], unk_id=0, byte_fallback=True))
    draw = random.Random(2)
    texts = ["".join(draw.choice("abc the ing   \n\t12é中ĐЖ😀tion") for _ in range(draw.randint(0, 80))) for _ in range(300)] + ["", "   ", " a", "x" * 700, "😀" * 200]
    flat, upto = model.encode(texts)
    bounds = [0, *upto.tolist()]
    got = [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [other.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids if t else [] for t in texts]
    assert model.decode(flat, upto) == texts


def test_pieces_of_odd_rows(odd_docs, no_docs):
    rows = encode_documents(odd_docs, PIECE_PATH).collect()
    assert len(rows) == odd_docs.count() and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert encode_documents(no_docs, PIECE_PATH).count() == 0


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted((n for n, c in lengths.items() for _ in range(c)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    draw = random.Random(3)
    for _ in range(150):
        capacity = draw.choice([1, 7, 20, 64, 100])
        lengths = {draw.randint(1, capacity): draw.randint(1, 30) for _ in range(draw.randint(1, 12))}
        used = {}
        for length, a, b, first, each, offset in best_fit(lengths, capacity):
            for k in range(b - a):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        for spans in used.values():
            ends = 0
            for offset, length in sorted(spans):
                assert offset == ends
                ends += length
            assert ends <= capacity
        assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == one_by_one(lengths, capacity)


def test_packing_of_odd_rows(odd_docs, no_docs, library):
    rows = pack_documents(odd_docs, WORD_PATH, 2048).collect()
    sizes = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect()]
    assert sum(r["length"] for r in rows) == sum(sizes)
    assert len(rows) == sum(-(-n // 2048) for n in sizes)
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in spans.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(spans) == len(one_by_one({n: sum(r["length"] == n for r in rows) for n in {r["length"] for r in rows}}, 2048))
    assert pack_documents(no_docs, WORD_PATH, 2048).count() == 0


def test_pieces_of_words_with_equal_codes_come_back():
    model = pieces(PIECE_PATH)
    texts = morse_texts()
    flat, upto = model.encode(texts)
    assert model.decode(flat, upto) == texts
    alone = [model.encode([t])[0].tolist() for t in texts]
    assert [x.tolist() for x in np.split(flat, upto[:-1])] == alone


def test_the_packing_plan_starts_no_workers(spark):
    """The plan is a local relation; rows of Python lists took a second kind of workers on every executor."""
    pieces = spark.range(5).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "id + 1 AS length", "id AS ids_crc32")
    packed = pack(pieces, 8)
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert packed.count() == 5 and pack(pieces.where("false"), 8).count() == 0


def test_workers_get_small_batches(spark):
    """Ten thousand texts of a thousand bytes are not one batch."""
    rows = spark.range(0, 10_000, 1, 1).select(F.expr("repeat('x', 1000)").alias("text"))

    def work(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.column("text").buffers()[2].size])], ["bytes"])

    assert by_slices(rows, "text", work, "bytes long").agg(F.max("bytes")).first()[0] < 4_000_000
