"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of a text are Spark column expressions. Small boosted trees are grown on a bounded
labelled sample; every path from a root is a rule, a conjunction of bounds on statistics. A
logistic model with lasso penalty over the rules leaves few of them, and these are compiled into
one column expression, so scoring stays in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 40, 3, 48, 12, 0.3
#: Lasso penalty per row.
PENALTY = 4e-4

Condition = tuple[str, str, float]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by name; shares are 0 for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))

    def of_chars(some: str) -> Column:
        return share(chars - F.length(F.translate(text, some, "")), chars)

    return {
        "n_chars": chars.cast("double"),
        "n_words": F.size(words).cast("double"),
        "word_length": share(chars, F.size(words)),
        "symbols": of_chars("#$%&*@^~+=<>_\\/"),
        "bars": of_chars("|"),
        "exclamations": of_chars("!?"),
        "stops": of_chars(".,;:"),
        "digits": of_chars("0123456789"),
        "capitals": share(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), chars),
        "letters": share(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), chars),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": share(chars, F.size(lines)),
    }


@dataclass
class Model:
    """Rules with their weights; the score is the logistic function of bias and weights."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """Column expression over columns named like the statistics."""
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = None
            for name, sign, bound in conditions:
                c = F.col(f"`{name}`") <= bound if sign == "<=" else F.col(f"`{name}`") > bound
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(codes: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray,
          path: tuple, depth: int, paths: list, shift: np.ndarray) -> None:
    """Grow one regression tree on binned statistics; adds paths, and the leaves' steps to ``shift``."""
    g, h = residual[rows], hessian[rows]
    best, split = 1e-9, None
    if depth and len(rows) >= 2 * LEAST_ROWS:
        base = g.sum() ** 2 / (h.sum() + 1)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            code = codes[rows, f]
            sums = [np.cumsum(np.bincount(code, weights=w, minlength=len(cuts) + 1))[:-1] for w in (g, h, np.ones(len(rows)))]
            gain = sums[0] ** 2 / (sums[1] + 1) + (g.sum() - sums[0]) ** 2 / (h.sum() - sums[1] + 1) - base
            gain[(sums[2] < LEAST_ROWS) | (len(rows) - sums[2] < LEAST_ROWS)] = -1
            at = int(gain.argmax())
            if gain[at] > best:
                best, split = gain[at], (f, at)
    if path:
        paths.append(path)
    if split is None:
        shift[rows] = RATE * g.sum() / (h.sum() + 1)
        return
    f, at = split
    low = codes[rows, f] <= at
    for sign, part in (("<=", rows[low]), (">", rows[~low])):
        _tree(codes, edges, residual, hessian, part, (*path, (f, sign, float(edges[f][at]))), depth - 1, paths, shift)


def _simple(path: tuple) -> tuple:
    """A path with the tightest bound of each statistic and sign, in a fixed order."""
    bounds: dict[tuple[int, str], float] = {}
    for f, sign, bound in path:
        old = bounds.get((f, sign))
        bounds[f, sign] = bound if old is None else (min if sign == "<=" else max)(old, bound)
    return tuple(sorted((f, s, b) for (f, s), b in bounds.items()))


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, bound in rule:
        out &= x[:, f] <= bound if sign == "<=" else x[:, f] > bound
    return out


def fit(x: np.ndarray, label: np.ndarray, names: list[str], penalty: float = PENALTY, rounds: int = 400) -> Model:
    """Rules and weights from statistics (rows by names) and labels 0 or 1."""
    positive = float(label.sum())
    prior = np.log((positive + 1) / (len(label) - positive + 1))
    if not len(label) or positive in (0.0, float(len(label))):
        return Model(prior)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    logit, rules = np.full(len(label), prior), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        paths, shift = [], np.zeros(len(label))
        _tree(codes, edges, label - p, p * (1 - p), np.arange(len(label)), (), DEPTH, paths, shift)
        logit = logit + shift
        rules.update(dict.fromkeys(map(_simple, paths)))
    held = {}
    for rule in rules:  # of rules that hold for the same rows, the shortest
        key = _holds(x, rule)
        if 0 < key.sum() < len(x):
            packed = np.packbits(key).tobytes()
            if packed not in held or len(rule) < len(held[packed]):
                held[packed] = rule
    rules = list(held.values())
    if not rules:
        return Model(prior)
    z = np.stack([_holds(x, r) for r in rules], axis=1).astype(np.float32)
    mean = z.mean(axis=0)
    z -= mean
    step = 4 / (np.linalg.norm(z.T @ z, 2) / len(z) + 1e-9)
    w, bias, ahead, momentum = np.zeros(len(rules)), prior, np.zeros(len(rules)), 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-(z @ ahead + bias))) - label
        new = ahead - step * (z.T @ error) / len(z)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias -= 4 * error.mean()
        momentum, old = (1 + np.sqrt(1 + 4 * momentum**2)) / 2, momentum
        ahead, w = new + (old - 1) / momentum * (new - w), new
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(
        float(bias - mean[used] @ w[used]),
        [(tuple((names[f], s, b) for f, s, b in rules[i]), float(w[i])) for i in used],
    )


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled rows: the first by hash of their id.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; null labels are skipped, and of
    several labels of an id the lower counts. The chosen ids, at most ``most``, are broadcast, so no
    text is shuffled, and only statistics reach the driver.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    named = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *[c.alias(n) for n, c in named.items()])
    got = rows.orderBy(F.xxhash64("doc_id"), *named).limit(most).toPandas()
    return fit(got[list(named)].to_numpy(np.float64), got["quality"].to_numpy(np.float64), list(named))


def rate(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and score (0 to 1) and predicted (1 if the score is at least 0.5).

    Null texts are rated like empty ones. Rows are taken one by one without a shuffle; an empty
    table gives no rows. Columns called score or predicted are replaced, others pass through
    whatever their names: the statistics live in a struct of their own.
    """
    named = statistics(F.col(f"`{text_column}`"))
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    kept = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    scored = docs.select(kept, *[c.alias(n) for n, c in named.items()]).select("__row", model.score().alias("__score"))
    return scored.select(*[F.col("__row").getField(c).alias(c) for c in names], F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
