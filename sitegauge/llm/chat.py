"""Chat formatting at token level.

A turn is ``[INST] role [/INST] text </s>``: the three marks are reserved token ids that no text
can give, roles and texts are encoded apart from each other, and the ids are spliced. Control
strings that occur inside roles and texts are escaped, so the rendered text can be cut at its
marks as well. Which tokens a model learns from follows from prefix sums over segment lengths.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Marks of the template: before a role, after it, after a text.
ROLE, TEXT, END = "[INST]", "[/INST]", "</s>"
#: Strings that must not stand in a rendered text unescaped: the marks and those of common templates.
CONTROLS = (
    ROLE, TEXT, END, "<s>", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<|endoftext|>", "<|startoftext|>",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>",
)
#: Escape sign, what follows it for the sign itself, and what follows it inside a broken control string.
SIGN, ITSELF, BROKEN = "␛", "␀", "␁"
_STARTS = re.compile(f"({SIGN})|(?=(?:{'|'.join(map(re.escape, CONTROLS))}))(.)", re.DOTALL)
_ESCAPED = re.compile(f"{SIGN}([{ITSELF}{BROKEN}])")
#: Turns of one slice of a conversation.
SLICE_TURNS = 128
#: Segments that the tokenizer gets at once.
BATCH_SLICES = 256


def escape(text: str) -> str:
    """Text without control strings. ``SIGN ITSELF`` stands for the sign; ``SIGN BROKEN`` is put after
    the first character of every control string, also where these overlap."""
    return _STARTS.sub(lambda m: SIGN + ITSELF if m[1] else m[2] + SIGN + BROKEN, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: SIGN if m[1] == ITSELF else "", text)


@dataclass
class Template:
    """Tokenizer of the segments, and the reserved ids after its vocabulary."""

    tokenizer: Tokenizer
    role: int
    text: int
    end: int

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([escape(s) for s in segments], add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return unescape(self.tokenizer.decode(ids.tolist(), skip_special_tokens=False))


@functools.lru_cache(2)
def template(path: str) -> Template:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text in a segment
    first = tokenizer.get_vocab_size(with_added_tokens=True)
    return Template(tokenizer, first, first + 1, first + 2)


def assemble(turns: list[tuple[str, str]], ids: list[list[int]], form: Template, learned: frozenset[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """Token ids, loss mask and rendered text of turns whose encoded roles and texts alternate in ``ids``."""
    lengths = np.array([len(x) for x in ids], np.int64).reshape(-1, 2)
    # Per turn: mark, role, mark, text, mark. The prefix sums of these lengths are the places.
    parts = np.ones((len(turns), 5), np.int64)
    parts[:, 1::2] = lengths
    ends = np.cumsum(parts.reshape(-1)).reshape(-1, 5)
    total = int(ends[-1, 4]) if len(turns) else 0
    out = np.empty(total, np.int32)
    content = np.ones(total, bool)
    for column, mark in ((0, form.role), (2, form.text), (4, form.end)):
        out[ends[:, column] - 1] = mark
        content[ends[:, column] - 1] = False
    out[content] = np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
    # +1 where a learned text begins and -1 where it ends; the running sum is the mask.
    edges = np.zeros(total + 1, np.int8)
    chosen = np.array([role in learned for role, _ in turns], bool)
    np.add.at(edges, ends[chosen, 2], 1)
    np.add.at(edges, ends[chosen, 3], -1)
    mask = np.cumsum(edges[:-1], dtype=np.int8)
    shown = "".join(f"{ROLE}{escape(r)}{TEXT}{escape(t)}{END}" for r, t in turns)
    return out, mask, shown


def format_chats(rows: DataFrame, path: str, learned: tuple[str, ...] = ("assistant",), slice_turns: int = SLICE_TURNS) -> DataFrame:
    """Formatted conversations in slices: conv_id, slice, ids, loss_mask, formatted.

    ``rows`` has conv_id, turn, role and text; other columns are not read. Turns are ordered by
    number, then role and text, null numbers last; rows that repeat a turn are all kept. A null
    role or text is empty; rows of a null conv_id form one conversation. A slice holds the turns of
    a span of ``slice_turns`` turn numbers; its tokens are those of the whole conversation at that
    place, because turns are encoded apart. Most conversations are one slice, and a conversation
    that holds a third of all rows is spread over many. ``loss_mask`` is 1 on the text tokens of
    the roles in ``learned``. An empty table gives no rows.
    """
    turns = rows.select("conv_id", F.coalesce(F.floor(F.col("turn") / slice_turns), F.lit((1 << 62))).cast("long").alias("slice"), F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    slices = turns.groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    slices = slices.select("conv_id", "slice", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, wanted = template(path), frozenset(learned)
        for whole in batches:
            for batch in (whole.slice(i, BATCH_SLICES) for i in range(0, whole.num_rows, BATCH_SLICES)):
                chats = [list(zip(r, t, strict=True)) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
                encoded = form.encode([s for chat in chats for turn in chat for s in turn])
                ids, masks, shown, at = [], [], [], 0
                for chat in chats:
                    i, m, text = assemble(chat, encoded[at : at + 2 * len(chat)], form, wanted)
                    at += 2 * len(chat)
                    ids.append(i)
                    masks.append(m.tobytes())
                    shown.append(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("slice"), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.binary()), pa.array(shown, pa.string())],
                    ["conv_id", "slice", "ids", "loss_mask", "formatted"],
                )

    return slices.mapInArrow(work, "conv_id long, slice long, ids array<int>, loss_mask binary, formatted string")


def read_back(ids: np.ndarray, mask: np.ndarray, form: Template) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns, and the texts under the loss mask, from ids and mask alone."""
    marks = np.flatnonzero(ids >= form.role)
    turns = []
    for a, b, c in marks.reshape(-1, 3):
        if (ids[a], ids[b], ids[c]) != (form.role, form.text, form.end):
            raise ValueError("the marks of a turn are out of order")
        turns.append((form.decode(ids[a + 1 : b]), form.decode(ids[b + 1 : c])))
    edges = np.flatnonzero(np.diff(mask, prepend=0, append=0)).reshape(-1, 2)
    return turns, [form.decode(ids[a:b]) for a, b in edges]


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a rendered text."""
    found = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(ROLE).partition(TEXT)
        found.append((unescape(role), unescape(text)))
    return found


def digests(chats: DataFrame, path: str) -> DataFrame:
    """One row a conversation, read back from the rows of ``format_chats``.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars and
    loss_sha256 (of all text under the loss mask), formatted_chars. Slices are decoded where they
    are; then the decoded text of a conversation goes through one running digest, slice by slice
    in order and without being gathered, since SHA-256 has no parts that could be joined.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(path)
        for whole in batches:
            for batch in (whole.slice(i, BATCH_SLICES) for i in range(0, whole.num_rows, BATCH_SLICES)):
                out = []
                for ids, mask, shown in zip(batch.column("ids"), batch.column("loss_mask"), batch.column("formatted"), strict=True):
                    turns, texts = read_back(ids.values.to_numpy(zero_copy_only=False), np.frombuffer(mask.as_py(), np.int8), form)
                    rendered = shown.as_py()
                    if parse(rendered) != turns:
                        raise ValueError("rendered text and tokens hold different turns")
                    learned = "".join(texts)
                    out.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), learned.encode(), len(learned), len(rendered)))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("slice"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    ["conv_id", "slice", "n_turns", "turns", "learned", "loss_chars", "formatted_chars"],
                )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state = [], None, None

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("conv_id", "n_turns", "turns", "learned", "loss_chars", "formatted_chars")), strict=True):
                conv, n, turns, learned, chars, shown = (x.as_py() for x in row)
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns)
                state[2] += chars
                state[3].update(learned)
                state[4] += shown
            yield flush()
            done.clear()
        close()
        yield flush()

    decoded = chats.mapInArrow(decode, "conv_id long, slice long, n_turns long, turns binary, learned binary, loss_chars long, formatted_chars long")
    ordered = decoded.repartition("conv_id").sortWithinPartitions("conv_id", "slice")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
