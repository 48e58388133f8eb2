import hashlib
import random
from itertools import product as combinations

import pytest

from sitegauge.llm import repair_grammar as g
from sitegauge.llm.conversation_repair import digests, repair


def enumerated(symbols):
    """Cheapest edits by trying all of them, with up to two inserts in every place."""
    found = []
    for edits in combinations("DKR", repeat=len(symbols)):
        for inserts in combinations(range(3), repeat=len(symbols) + 1):
            state, cost, audit = g.START, 0, ""
            for sym, edit, n in zip([*symbols, None], [*edits, ""], inserts):
                for _ in range(n):
                    state, cost, audit = g.NEXT[state], cost + 3, audit + "I"
                if sym is None:
                    break
                audit += edit
                if edit == "D":
                    cost += 4
                    continue
                role = g.role_of(sym)
                if sym == g.GONE or edit == "K" and not (role == 0 and state == g.START or role == g.NEXT[state] - 1):
                    break
                cost += 3 * (edit == "R") + 3 * ((sym - 1) % 2)
                state = g.SYSTEM if edit == "K" and role == 0 else g.NEXT[state]
            else:
                raise AssertionError
            if sym is None and state in (g.START, g.ASSISTANT):
                found.append((cost, audit))
    return min(found)


def test_cheapest_edits_of_all_short_sequences():
    for n in range(3):
        for symbols in combinations(range(g.SYMBOLS), repeat=n):
            assert g.cheapest(g.chain([g.LETTERS[s] for s in symbols])) == enumerated(symbols)
    draw = random.Random(3)
    for _ in range(60):
        symbols = [draw.randrange(g.SYMBOLS) for _ in range(draw.randint(3, 4))]
        assert g.cheapest(g.chain([g.LETTERS[s] for s in symbols])) == enumerated(symbols)


def plain(symbols):
    """Row by row with whole strings."""
    states = {g.START: (0, "")}
    for matrix in [*[g.LETTERS[s] for s in symbols], g.INSERTS]:
        after = {}
        for p, (cost, audit) in states.items():
            for q in range(4):
                if matrix[4 * p + q]:
                    more, edits = matrix[4 * p + q]
                    after[q] = min(after.get(q, (1 << 60, "")), (cost + more, audit + g.text(edits)))
        states = after
    return min(states[q] for q in (g.START, g.ASSISTANT) if q in states)


def test_grammar_gives_the_same_edits():
    draw = random.Random(5)
    motif = bytes(draw.randrange(g.SYMBOLS) for _ in range(40))
    sequences = [b"", bytes(300), b"\x05" * 301, motif * 50] + [
        bytes(draw.choice((3, 5, 5, 3, 0, 4, 6, draw.randrange(9))) for _ in range(draw.randint(0, 90))) for _ in range(200)
    ]
    grammar = g.re_pair(sequences)
    assert grammar.rules and sum(map(len, grammar.rest)) < sum(map(len, sequences)) / 3
    known = [[s] for s in range(g.SYMBOLS)]
    for left, right in grammar.rules:
        known.append(known[left] + known[right])
    for sequence, rest, matrix in zip(sequences, grammar.rest, grammar.matrices(), strict=True):
        assert bytes(x for s in rest for x in known[s]) == sequence
        assert g.cheapest(matrix) == plain(sequence)


ROWS = [
    (1, 0, "system", "be kind."), (1, 1, "user", "a?"), (1, 2, "assistant", "b!"),
    (2, 0, "user", "hello"), (2, 0, "user", "hello"), (2, 3, "assistant", "x. \n"), (2, 5, "user", "hello"),
    (3, None, None, None), (3, None, "user", ""), (3, 2, "tool", "t."), (3, 2, "", "u."), (4, None, "user", "q."),
    (None, 0, "user", "lost."), (None, 1, "user", "more."), (6, 1, "assistant", "é."), (6, 0, "system", "s."), (7, 0, "user", "w " * 200_000 + "."),
    *[(5, i // 2, ("user", "assistant", "system", "user")[i % 4], ("" if i % 7 == 0 else f"turn {i % 300}") + ".!"[i % 2]) for i in range(3000)],
    *[(8, 1, "user", "same.") for _ in range(700)], *[(9, None, "user", f"text {i}.") for i in range(900)],
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv))
        turns = [t for known, t, *_ in own if known]
        symbols, counts, seen = [], [0, 0, 0], set()
        for *_, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append(g.symbol(role, fault in (0, 1), fault == 2))
        cost, audit = plain(bytes(symbols))
        said, _ = g.replay(audit, bytes(symbols), g.START)
        lines = [f"{role if role is not None else own[i][2]}:{'' if i < 0 else own[i][3]}" for i, role in said]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts,
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def run(df):
    found, turns = repair(df)
    sums = {r["conv_id"]: r["repaired_sha256"] for r in digests(turns).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: (*(r[n] for n in names), sums.pop(r["conv_id"])) for r in found.collect()} | sums


@pytest.mark.parametrize("parts", [1, 7])
def test_against_row_by_row(spark, parts):
    """Long conversations in slices, nulls, repeated rows, odd roles, long texts and columns of clashing names."""
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(parts)
    assert run(df.selectExpr("*", *[f"'x' AS {c}" for c in ("slice", "n", "said", "first", "audit", "roles", "earliest", "blank")])) == expected(ROWS)


def test_no_rows(spark):
    assert run(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}
