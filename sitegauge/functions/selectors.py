"""CSS selectors over the element array of a page.

A selector is compiled to chains of compound tests. What concerns one element alone (tag, class,
id, attributes) is a column expression and becomes one bit of a mask per element. What relates
elements (descendants, children, siblings, places among siblings) is answered from their numbers:
positions, ends and parents of all elements in document order, by vector steps whose cost is the
number of elements. All selectors of a page are answered in one step.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.html import tag_marks
from sitegauge.functions.nesting import CLOSE, nest

#: Compound tests of one number of the mask.
MASK_BITS = 62

_NAME = r"[\w-]+"
_PART = re.compile(
    rf"""\s*(?:(?P<comma>,)|(?P<combinator>[>+~]))\s*|(?P<space>\s+)|(?P<any>\*)|(?P<tag>[a-zA-Z][\w-]*)|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\s\]"']+))\s*(?P<fold>[iI])?\s*)?\]
    |:(?P<pseudo>first-child|last-child|only-child)(?![\w(-])|:nth-child\(\s*(?P<nth>[^)]*?)\s*\)|:(?P<inner>not|is)\(""",
    re.VERBOSE,
)
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?")


@dataclass(frozen=True)
class Compound:
    """Tests of one element: its own, places among siblings as (kind, a, b), and selectors it must (not) be among."""

    own: tuple[tuple[str, ...], ...] = ()
    places: tuple[tuple[str, int, int], ...] = ()
    inner: tuple[tuple[str, tuple[Compound, ...]], ...] = ()


#: A chain is the first compound and then (combinator, compound); a selector is a group of chains.
Chain = tuple[tuple[str, Compound], ...]
Selector = tuple[Chain, ...]


def _place(expression: str, selector: str) -> tuple[str, int, int]:
    """``an+b`` of a place among siblings."""
    text = {"odd": "2n+1", "even": "2n"}.get(expression.lower(), expression.lower())
    match = _NTH.fullmatch(text)
    if not text or match is None:
        raise ValueError(f"selector not understood: {selector!r}")
    step = match["a"]
    a = 0 if step is None else int(step + "1") if step in ("", "+", "-") else int(step)
    return "nth", a, int((match["b"] or "0").replace(" ", ""))


def parse(selector: str) -> Selector:
    """Chains of a selector group; a form that is none raises ``ValueError``."""
    chains, end = _group(selector.strip(), 0, selector, False)
    return chains


def _group(text: str, at: int, selector: str, nested: bool) -> tuple[Selector, int]:
    wrong = ValueError(f"selector not understood: {selector!r}")
    chains: list[Chain] = []
    steps: list[tuple[str, Compound]] = []
    combinator, own, places, inner, filled = "", [], [], [], False

    def close() -> None:
        nonlocal own, places, inner, filled
        if not filled:
            raise wrong
        steps.append((combinator, Compound(tuple(own), tuple(places), tuple(inner))))
        own, places, inner, filled = [], [], [], False

    while at < len(text) and not (nested and text[at] == ")"):
        m = _PART.match(text, at)
        if m is None:
            raise wrong
        at = m.end()
        if m["space"]:
            if at < len(text) and text[at] not in ",>+~" and not (nested and text[at] == ")"):
                close()
                combinator = " "
        elif m["comma"]:
            close()
            chains.append(tuple(steps))
            steps, combinator = [], ""
        elif m["combinator"]:
            close()
            combinator = m["combinator"]
        else:
            if (m["tag"] or m["any"]) and filled:
                raise wrong
            filled = True
            if m["tag"]:
                own.append(("tag", m["tag"].lower()))
            elif m["cls"]:
                own.append(("class", m["cls"]))
            elif m["id"]:
                own.append(("=", "id", m["id"], ""))
            elif m["attr"]:
                value = next((v for v in (m["double"], m["single"], m["bare"]) if v is not None), "")
                own.append((m["op"] or "has", m["attr"].lower(), value, (m["fold"] or "").lower()))
            elif m["pseudo"]:
                places += {"first-child": [("nth", 0, 1)], "last-child": [("last", 0, 1)], "only-child": [("nth", 0, 1), ("last", 0, 1)]}[m["pseudo"]]
            elif m["nth"] is not None:
                places.append(_place(m["nth"], selector))
            elif m["inner"]:
                group, at = _group(text, at, selector, True)
                if at >= len(text) or any(len(chain) > 1 for chain in group):
                    raise wrong
                at += 1
                inner.append((m["inner"], tuple(chain[0][1] for chain in group)))
    close()
    chains.append(tuple(steps))
    return tuple(chains), at


# --- the element itself: column expressions ---------------------------------------------------


def _test(e: Column, test: tuple[str, ...]) -> Column:
    kind, *rest = test
    if kind == "tag":
        return e["tag"] == rest[0]
    if kind == "class":
        return F.array_contains(F.split(F.coalesce(e["attrs"]["class"], F.lit("")), r"\s+"), rest[0])
    name, value, fold = rest
    given = e["attrs"][name]
    if kind == "has":
        return given.isNotNull()
    if fold:
        given, value = F.lower(given), value.lower()
    if kind == "=":
        return given == value
    if kind == "|=":
        return (given == value) | given.startswith(value + "-")
    if not value or kind == "~=" and re.search(r"\s", value):
        return F.lit(False)  # an empty part is in no value
    if kind == "~=":
        return F.array_contains(F.split(given, r"\s+"), value)
    return {"^=": given.startswith, "$=": given.endswith, "*=": given.contains}[kind](value)


def _compounds(program: tuple[str, ...]) -> dict[tuple, int]:
    """Bit of the own tests of every compound."""
    found: dict[tuple, int] = {}

    def add(compound: Compound) -> None:
        found.setdefault(compound.own, len(found))
        for _, group in compound.inner:
            for c in group:
                add(c)

    for selector in program:
        for chain in parse(selector):
            for _, compound in chain:
                add(compound)
    return found


def masks(els: Column, program: tuple[str, ...]) -> Column:
    """Numbers with one bit a compound for every element: ``array<array<bigint>>``, 62 compounds each."""
    bits = sorted(_compounds(program).items(), key=lambda x: x[1])

    def mask(part: list[tuple[tuple, int]]) -> Column:
        def of(e: Column) -> Column:
            value = F.lit(0).cast("bigint")
            for own, bit in part:
                holds = F.lit(True)
                for test in own:
                    holds = holds & _test(e, test)
                value = value + F.when(holds, F.lit(1 << (bit % MASK_BITS)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            return value

        return F.transform(els, of)

    return F.array(*[mask(bits[i : i + MASK_BITS]) for i in range(0, len(bits), MASK_BITS)])


# --- elements to one another: vector steps -----------------------------------------------------


class Tree:
    """Elements of a page in document order: position, end, number of the parent (-1: none)."""

    def __init__(self, pos: np.ndarray, close: np.ndarray, parent: np.ndarray) -> None:
        self.pos, self.close, self.parent = pos, close, parent
        n = len(pos)
        self.order = np.argsort(parent, kind="stable")  # siblings together, in document order
        grouped = parent[self.order]
        self.start = np.flatnonzero(np.diff(grouped, prepend=-2)) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(self.start, n))
        first = np.repeat(self.start, sizes)
        self.nth, self.last, self.before = (np.empty(n, np.int64) for _ in range(3))
        self.nth[self.order] = np.arange(n) - first + 1
        self.last[self.order] = np.repeat(sizes, sizes) - (np.arange(n) - first)
        self.before[self.order] = np.where(np.arange(n) > first, np.roll(self.order, 1), -1)
        self.first = first

    def below(self, marked: np.ndarray) -> np.ndarray:
        """Elements inside a marked one: spans are nested, so the farthest end so far decides."""
        reach = np.maximum.accumulate(np.where(marked, self.close, -1))
        return np.concatenate([[False], reach[:-1] > self.pos[1:]])

    def children(self, marked: np.ndarray) -> np.ndarray:
        return (self.parent >= 0) & marked[self.parent]

    def next_to(self, marked: np.ndarray) -> np.ndarray:
        return (self.before >= 0) & marked[self.before]

    def after(self, marked: np.ndarray) -> np.ndarray:
        """Elements with a marked sibling before them."""
        sorted_marks = marked[self.order]
        so_far = np.cumsum(sorted_marks) - sorted_marks
        out = np.empty(len(marked), bool)
        out[self.order] = so_far - so_far[self.first] > 0
        return out

    def at(self, place: tuple[str, int, int]) -> np.ndarray:
        kind, a, b = place
        n = (self.nth if kind == "nth" else self.last) - b
        return n == 0 if a == 0 else (n % a == 0) & (n // a >= 0)


def select(program: list[Selector], bits: dict[tuple, int], tree: Tree, mask: np.ndarray) -> list[np.ndarray]:
    """Numbers of the elements that each selector matches, in document order."""
    def holds(compound: Compound) -> np.ndarray:
        bit = bits[compound.own]
        found = (mask[bit // MASK_BITS] >> (bit % MASK_BITS)) & 1 > 0
        for place in compound.places:
            found &= tree.at(place)
        for kind, group in compound.inner:
            among = np.logical_or.reduce([holds(c) for c in group])
            found &= among if kind == "is" else ~among
        return found

    steps = {" ": tree.below, ">": tree.children, "+": tree.next_to, "~": tree.after}
    out = []
    for selector in program:
        hits = np.zeros(len(tree.pos), bool)
        for chain in selector:
            found = holds(chain[0][1])
            for combinator, compound in chain[1:]:
                found = holds(compound) & steps[combinator](found)
            hits |= found
        out.append(np.flatnonzero(hits))
    return out


def matches(toks: Column, opened: Column, programs: tuple[tuple[str, ...], ...], which: Column) -> Column:
    """``array<array<int>>``: the result of :func:`nested_ends`, then for each selector of the row's
    program the numbers of the elements it matches.

    ``which`` is the number of the program; masks are made for that one only. Ends and matches come
    from one step, as Spark plans no Python step on the result of another inside one expression.
    """
    compiled = [([parse(s) for s in program], _compounds(program)) for program in programs]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def answer(number: pd.Series, mask: pd.Series, marks: pd.Series, positions: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for i, m, tags, at, stop in zip(number, mask, marks, positions, end, strict=True):
            program, bits = compiled[i]
            placed = nest(tags, at, stop)
            n = len(placed) // 3
            found = [[]] * len(program)
            if n:
                opened_at = [p for t, p in zip(tags.split(" "), at, strict=True) if t[0] != CLOSE]
                tree = Tree(np.array(opened_at, np.int64), np.array(placed[:n], np.int64), np.array(placed[2 * n :], np.int64))
                found = [x.tolist() for x in select(program, bits, tree, np.stack([np.asarray(x, np.int64) for x in m]))]
            out.append([placed, *found])
        return pd.Series(out, dtype=object)

    chosen = F.when(which == 0, masks(opened, programs[0]))
    for i, program in enumerate(programs[1:], 1):
        chosen = chosen.when(which == i, masks(opened, program))
    return answer(which, chosen, *tag_marks(toks))
