"""Repair of conversations: faults of their rows, the cheapest edits, and the repaired turns.

Rows are ordered by range, so a conversation of any length lies in slices. A slice is a sequence of
symbols; its transfer matrix comes from a grammar of all sequences of its batch. Matrices of the
slices of a conversation are multiplied in order, which gives cost and edits; then every slice is
edited where it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitegauge.llm.common import written
from sitegauge.llm.repair_grammar import GONE, chain, cheapest, cut, re_pair, replay, symbol, text

#: What a blank text consists of, and the signs that end a text.
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
#: Rows and bytes of a slice at most, unless a single row is longer or repeats more often.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
#: Symbols of which one grammar is made.
GRAMMAR_SYMBOLS = 200_000
#: Leading characters of a text by which rows of one turn are dealt.
RANGE_CHARS = 256
LEGAL = ("su", "ua", "au")

SLICES = (
    "conv_id long, slice long, symbols binary, roles array<string>, texts array<string>, counts array<int>, "
    "blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "n_turns long, first_turn long, last_turn long"
)
PIECES = (
    "conv_id long, slice long, piece string, state int, gaps long, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string"
)


def _batches(names: list[str], schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Different rows of every conversation: conv_id, turn, role, text, n, blank, first, ended.

    ``n`` rows are equal in all four columns; ``first`` says that no row of an earlier turn has
    their role and text. Both are aggregates, so a conversation or text that fills a third of the
    table is combined in the tasks first.
    """
    plain = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    different = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.char_length("role").cast("string"), "role", "text")
    marked = different.withColumn("said", F.substring(F.unhex(F.sha2(said, 256)), 1, 16))
    earliest = marked.groupBy("said").agg(F.min(F.struct("turn")).alias("earliest"))
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    return marked.join(earliest, "said").select(
        "conv_id", "turn", "role", "text", "n", (bare == "").alias("blank"),
        F.col("turn").eqNullSafe(F.col("earliest.turn")).alias("first"),
        F.right(bare, F.lit(1)).isin(*ENDS).alias("ended"),
    )


def slices(rows: DataFrame, slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Conversations in slices of their rows in order, with symbols and counted faults.

    Slices of a conversation are in the order of ``slice``. Rows are range-partitioned by
    conversation and order, so a conversation that fills a third of the table is in many tasks.
    """
    names, schema = [f.split()[0] for f in SLICES.split(", ")], _arrow(SLICES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        done, held, conv, size = [], [], None, 0

        def close() -> None:
            nonlocal number, held, size
            if held:
                done.append((conv, number, *_slice(held)))
                number, held, size = number + 1, [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] != conv or len(held) >= slice_rows or size >= slice_bytes):
                    close()
                conv = row["conv_id"]
                held.append(row)
                size += len(row["text"]) + len(row["role"])
            yield _batches(names, schema, done)
            done = []
        close()
        yield _batches(names, schema, done)

    order = ("conv_id", "turn", "role")
    ordered = faulty_rows(rows).repartitionByRange(*order, F.substring("text", 1, RANGE_CHARS))
    return ordered.sortWithinPartitions(*order, "text").mapInArrow(work, SLICES)


def _slice(rows: list[dict]) -> tuple:
    symbols = bytearray()
    blank = duplicate = truncated = illegal = 0
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    before = None
    for r in rows:
        n, role = r["n"], r["role"][:1]
        if before is not None:
            illegal += before + role not in LEGAL
        illegal += n - 1  # a role never follows itself
        before = role
        if r["blank"]:
            blank += n
            symbols += bytes([GONE]) * n
            continue
        duplicate += n - r["first"]
        if r["first"]:
            truncated += not r["ended"]
            symbols.append(symbol(role, False, not r["ended"]))
        symbols += bytes([GONE]) * (n - r["first"])
    return (
        bytes(symbols), [r["role"] for r in rows], [r["text"] for r in rows], [r["n"] for r in rows],
        blank, duplicate, truncated, illegal, rows[0]["role"][:1], rows[-1]["role"][:1],
        len(turns), turns[0] if turns else None, turns[-1] if turns else None,
    )


def cheapest_edits(cut_rows: DataFrame) -> DataFrame:
    """Edits of every slice, and on the first slice of a conversation its facts, cost and edits.

    Of each slice the task that has it makes a matrix of 16 costs and edits; what meets in one task
    for a conversation are these matrices. The edits of a conversation are one value of its row, so
    their length is what a task holds of it. The first slice's ``audit`` is not null.
    """
    names, schema = [f.split()[0] for f in PIECES.split(", ")], _arrow(PIECES)
    facts = ("blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "n_turns", "first_turn", "last_turn")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = batch.column("symbols").to_pylist()
            costs, edits, start = [], [], 0
            while start < len(sequences):
                end = start + 1
                held = len(sequences[start])
                while end < len(sequences) and held + len(sequences[end]) <= GRAMMAR_SYMBOLS:
                    held += len(sequences[end])
                    end += 1
                for matrix in re_pair(sequences[start:end]).matrices():
                    costs.append([None if e is None else e[0] for e in matrix])
                    edits.append([None if e is None else text(e[1]) for e in matrix])
                start = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))],
                [*batch.schema.names, "costs", "edits"],
            )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], []

        def close() -> None:
            if held:
                done.extend(_conversation(held))
                held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    close()
                held.append(row)
            yield _batches(names, schema, done)
            done.clear()
        close()
        yield _batches(names, schema, done)

    read = cut_rows.select("conv_id", "slice", "symbols", *facts)
    schema_with = T.StructType([*read.schema, T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.StringType()))])
    measured = read.mapInArrow(measure, schema_with)
    return measured.repartition("conv_id").sortWithinPartitions("conv_id", "slice").mapInArrow(combine, PIECES)


def _conversation(parts: list[dict]) -> list[tuple]:
    matrices = [[None if c is None else (c, e) for c, e in zip(p["costs"], p["edits"], strict=True)] for p in parts]
    cost, audit = cheapest(chain(matrices))
    illegal = sum(p["illegal"] for p in parts)
    illegal += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(parts, parts[1:]))
    numbered = [p for p in parts if p["n_turns"]]
    gaps = 0
    if numbered:
        n_turns = sum(p["n_turns"] for p in numbered)
        n_turns -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(numbered, numbered[1:]))
        gaps = numbered[-1]["last_turn"] - numbered[0]["first_turn"] + 1 - n_turns
    out, state = [], 0
    for i, (p, piece) in enumerate(zip(parts, cut(audit, [len(p["symbols"]) for p in parts]), strict=True)):
        facts = (gaps, *(sum(q[f] for q in parts) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit) if i == 0 else (None,) * 7
        out.append((p["conv_id"], p["slice"], piece, state, *facts))
        _, state = replay(piece, p["symbols"], state)
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their edits, and their repaired turns.

    ``rows`` has conv_id, turn, role and text; other columns are not read. The first frame has one
    row a conversation: conv_id, gaps (turn numbers that are missing between the least and the
    greatest), blank, duplicate and truncated (rows by their first fault), illegal (neighbours that
    do not follow one another), cost, audit (initials of the cheapest edits). The second has
    conv_id, slice, roles and texts of the turns after the edits, in order of slice.

    Rows are taken by turn, null turns first, then by role and text; a null role or text is one
    space. Rows with equal texts of one role in a conversation are duplicates but for the first,
    also where they repeat a whole row. Roles other than system, user and assistant count by their
    first letter. Rows of a null conv_id are one conversation; an empty table gives no rows.
    """
    cut_rows = written(slices(rows))
    pieces = written(cheapest_edits(cut_rows))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = [], []
            for row in batch.to_pylist():
                own = [i for i, n in enumerate(row["counts"]) for _ in range(n)]
                turns, _ = replay(row["piece"], row["symbols"], row["state"])
                roles.append([row["roles"][own[i]] if role is None else role for i, role in turns])
                texts.append(["" if i < 0 else row["texts"][own[i]] for i, _ in turns])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("slice"), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))],
                ["conv_id", "slice", "roles", "texts"],
            )

    found = pieces.where("audit IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    joined = cut_rows.select("conv_id", "slice", "symbols", "roles", "texts", "counts").join(pieces.select("slice", "piece", "state"), "slice")
    turns = joined.mapInArrow(edit, "conv_id long, slice long, roles array<string>, texts array<string>")
    return found, turns


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of all repaired turns of a conversation, joined by newlines: conv_id, repaired_sha256.

    A digest has no parts that could be joined, so the slices of a conversation go through it in
    order; they are not gathered.
    """
    names, schema = ["conv_id", "repaired_sha256"], _arrow("conv_id long, repaired_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state, said = [], None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state, said = row["conv_id"], hashlib.sha256(), False
                for role, words in zip(row["roles"], row["texts"], strict=True):
                    state.update(f"{chr(10) if said else ''}{role}:{words}".encode())
                    said = True
            yield _batches(names, schema, done)
            done = []
        if state is not None:
            done.append((key, state.hexdigest()))
        yield _batches(names, schema, done)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "slice")
    return ordered.mapInArrow(digest, "conv_id long, repaired_sha256 string")
