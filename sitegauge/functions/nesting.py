"""Where elements end: the stack machine of an HTML tree builder, over arrays of tags.

A stack needs time linear in the page only if it can be changed in place. Column expressions copy
arrays instead, which costs the square of the number of elements, so this one step runs in Arrow
batches: it gets the tags of a page as one string and gives back three numbers an element.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.constants import BOILERPLATE_TAGS

#: Marks before a closing tag and after a tag without children; no tag name has them.
CLOSE, LEAF = "/", ">"


def nest(marks: str, positions: list[int], end: int) -> list[int]:
    """End of every opening tag, then how many boilerplate elements are open around each, then the
    number of its parent among the opening tags (-1: none).

    A closing tag ends the nearest open element of its name together with everything opened
    inside it, and is ignored if none is open; elements left open end with the page; an element
    without children ends where it starts.
    """
    ends: list[int] = []
    depths: list[int] = []
    parents: list[int] = []
    stack: list[tuple[str, int]] = []
    heights: dict[str, list[int]] = {}
    hidden = 0
    for mark, position in zip(marks.split(" ") if marks else (), positions, strict=True):
        if mark[0] == CLOSE:
            name = mark[1:]
            if heights.get(name):
                height = heights[name][-1]
                while len(stack) > height:
                    tag, at = stack.pop()
                    heights[tag].pop()
                    ends[at] = position
                    hidden -= tag in BOILERPLATE_TAGS
        else:
            depths.append(hidden)
            parents.append(stack[-1][1] if stack else -1)
            if mark[-1] == LEAF:
                ends.append(position)
            else:
                heights.setdefault(mark, []).append(len(stack))
                stack.append((mark, len(ends)))
                ends.append(end)
                hidden += mark in BOILERPLATE_TAGS
    return ends + depths + parents


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nesting(marks: pd.Series, positions: pd.Series, end: pd.Series) -> pd.Series:
    """``nest`` of every page."""
    return pd.Series([nest(m, p, e) for m, p, e in zip(marks, positions, end, strict=True)], dtype=object)
