"""Selectors against a matcher that tries every element against every other."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegauge.functions import selectors as S
from sitegauge.operators import products as PD

TAGS = ("div", "ul", "li", "a", "span", "p")


def tree(draw, n):
    """Random elements in document order: tag, attributes, parent; with positions and ends."""
    elements, stack, position = [], [], 0
    for _ in range(n):
        while stack and draw.random() < 0.45:
            elements[stack.pop()]["close"] = position
            position += 1
        attrs = {}
        if draw.random() < 0.6:
            attrs["class"] = " ".join(draw.choice(("a", "b", "a-x", "card", "price")) for _ in range(draw.randint(0, 3)))
        if draw.random() < 0.4:
            attrs["href"] = draw.choice(("/p/1", "/p/2.jpg", "x y", "", "P"))
        elements.append({"tag": draw.choice(TAGS), "attrs": attrs, "parent": stack[-1] if stack else -1, "pos": position, "close": None})
        stack.append(len(elements) - 1)
        position += 1
    for i in stack:
        elements[i]["close"] = position
    return elements


def own(e, test):
    kind, *rest = test
    if kind == "tag":
        return e["tag"] == rest[0]
    if kind == "class":
        return rest[0] in e["attrs"].get("class", "").split()
    name, value, fold = rest
    given = e["attrs"].get(name)
    if given is None:
        return False
    given, value = (given.lower(), value.lower()) if fold else (given, value)
    return {
        "has": lambda: True, "=": lambda: given == value, "~=": lambda: value in given.split() and bool(value), "|=": lambda: given == value or given.startswith(value + "-"),
        "^=": lambda: value != "" and given.startswith(value), "$=": lambda: value != "" and given.endswith(value), "*=": lambda: value != "" and value in given,
    }[kind]()


def siblings(elements, i):
    return [j for j, e in enumerate(elements) if e["parent"] == elements[i]["parent"]]


def holds(elements, i, compound):
    same = siblings(elements, i)
    for kind, a, b in compound.places:
        n = same.index(i) + 1 if kind == "nth" else len(same) - same.index(i)
        if not any(a * k + b == n for k in range(len(elements) + 1)):
            return False
    return all(own(elements[i], t) for t in compound.own) and all(any(holds(elements, i, c) for c in group) == (kind == "is") for kind, group in compound.inner)


def reached(elements, i, chain):
    if not holds(elements, i, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    combinator, before = chain[-1][0], chain[:-1]
    same, up = siblings(elements, i), elements[i]["parent"]
    if combinator == ">":
        near = [up] if up >= 0 else []
    elif combinator == " ":
        near = []
        while up >= 0:
            near.append(up)
            up = elements[up]["parent"]
    else:
        near = same[: same.index(i)]
        near = near[-1:] if combinator == "+" else near
    return any(reached(elements, j, before) for j in near)


SELECTORS = (
    "div", "*", ".a", ".a.b", "ul > li", "ul li", "div > .a > span", "li + li", "li ~ a", "div .card, .price span", "a[href]", "a[href='/p/1']", '[href^="/p"]',
    "[href$=jpg]", "[href*='p/' i]", "[class~=price]", "[class|=a]", "li:first-child", "li:last-child", ":only-child", "li:nth-child(2n+1)", "li:nth-child( odd )", "*:nth-child(-n+2)",
    ":nth-child(3)", "li:nth-child(n)", "a:not(.a)", "div:not(.a, [href]) > span:not(:first-child)", ":is(ul, div) > li.card ~ li", "div div div", "div>ul>li+a~.b", "[href='']", "[href^='']",
)


def test_all_forms_against_brute_force():
    draw = random.Random(2)
    for n in (1, 2, 30, 120):
        elements = tree(draw, n)
        compiled, bits = [S.parse(s) for s in SELECTORS], S._compounds(SELECTORS)
        mask = np.zeros((-(-len(bits) // S.MASK_BITS), n), np.int64)
        for tests, bit in bits.items():
            for i, e in enumerate(elements):
                mask[bit // S.MASK_BITS, i] |= int(all(own(e, t) for t in tests)) << (bit % S.MASK_BITS)
        page = S.Tree(*(np.array([e[k] for e in elements]) for k in ("pos", "close", "parent")))
        for selector, chains, got in zip(SELECTORS, compiled, S.select(compiled, bits, page, mask), strict=True):
            assert got.tolist() == [i for i in range(n) if any(reached(elements, i, c) for c in chains)], selector


def test_selectors_of_pages(spark, page):
    """The same through markup and columns; more compounds than one mask holds."""
    draw = random.Random(9)
    elements = tree(draw, 60)
    marks = sorted([(e["pos"], "<%s %s>" % (e["tag"], " ".join(f'{k}="{v}"' for k, v in e["attrs"].items()))) for e in elements] + [(e["close"], f"</{e['tag']}>") for e in elements if sum(f["close"] == e["close"] for f in elements) == 1])
    html = "".join(m for _, m in marks)
    program = SELECTORS + tuple(f".x{i}" for i in range(70))
    rows = {r["selector"]: r["n"] for r in PD.select_elements(page(html), program).collect()}
    want = {s: sum(any(reached(elements, i, c) for c in S.parse(s)) for i in range(len(elements))) for s in program}
    assert rows == want


@pytest.mark.parametrize("wrong", ["", " ", ",", "a >> b", "> a", "a >", "a,", "[", "[a=", "a:hover", "a:not(b c)", "a:nth-child(x)", "a:not(", "a)", "..a", "adiv*", "a:first-childish"])
def test_what_is_no_selector_raises(wrong):
    with pytest.raises(ValueError):
        S.parse(wrong)


def test_time_is_linear_in_the_page(spark):
    def seconds(blocks):
        html = '<div class="product-card"><a href="/product/1">x</a><p class="price"><span class="amount">$1</span></p></div>' * blocks
        frame = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
        query = PD.select_elements(frame, (".product-card a", "div > p.price ~ p, .price .amount", "div + div"))
        query.select(F.sum("n")).collect()
        start = time.time()
        assert query.agg(F.sum("n")).first()[0] == 3 * blocks - 1
        return time.time() - start

    few, many = seconds(8_000), seconds(80_000)
    assert many < 12 * few, (few, many)


def test_program_order_does_not_matter():
    assert S.parse("a,b") == S.parse(" a , b ") and S.parse("a>b") == S.parse("a > b") and re.sub(r"\s", "", "a ~ b") == "a~b"
