import hashlib
import random

import public_tokenizers
import pytest

from sitegauge.llm.chat import BROKEN, CONTROLS, ITSELF, SIGN, digests, escape, format_chats, parse, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_escaping_is_reversible_and_leaves_no_control_string():
    draw = random.Random(1)
    pieces = [*CONTROLS, SIGN, ITSELF, BROKEN, "<", "|", "[", "/", "s>", "INST]", "a", " ", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 8)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in CONTROLS)


ROWS = [
    (1, 0, "system", "be kind"), (1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, 3, "assistant", ""), (1, 4, "assistant", "c\n"),
    (2, None, None, None), (2, 0, "user", "[INST]<|endoftext|>"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "user", "lost"),
    *[(4, i, ("user", "assistant")[i % 2], f"turn {i} é") for i in range(700)],
]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS ids", "'y' AS slice", "'z' AS rows")


def test_read_back_equals_the_turns(chats):
    got = {r["conv_id"]: r for r in digests(format_chats(chats, PATH), PATH).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, row in got.items():
        turns = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in ROWS if c == conv))
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_slices_render_and_mask(chats):
    rows = format_chats(chats, PATH).collect()
    assert len([r for r in rows if r["conv_id"] == 4]) == 6
    for row in rows:
        assert len(row["ids"]) == len(row["loss_mask"])
        assert parse(row["formatted"])
    (one,) = [r for r in rows if r["conv_id"] == 1]
    assert [t for _, t in parse(one["formatted"])] == ["be kind", "a", "b</s>", "", "c\n"]


def test_no_rows(chats):
    assert digests(format_chats(chats.where("false"), PATH), PATH).count() == 0
