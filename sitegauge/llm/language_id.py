"""Language identification: averaged hashed subword embeddings under a linear softmax.

Text is lower-cased, everything but letters becomes a boundary, and words with their boundaries
are cut into byte n-grams. N-grams hash to rows of an embedding table; the mean of a text's rows
goes through a linear softmax layer. Table and layer are trained together by stochastic gradient
descent in numpy, then a temperature is fitted on rows kept from the training, and the score below
which a text is rejected is set there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import by_slices, fresh, texts_of

#: Rows of the embedding table, and its width.
BUCKETS, WIDTH = 1 << 15, 16
#: Byte lengths of the subwords.
LENGTHS = (2, 3, 4)
#: Label of texts without a letter.
UNDETERMINED = "und"
#: Bounds of the training sample: rows of one language, and in all (shared out evenly).
SAMPLE_PER_LANGUAGE, SAMPLE = 600, 6000
#: Share of right answers on the kept rows that the rejection threshold may cost at most.
REJECT_SHARE = 0.001
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def grams(text: str) -> np.ndarray:
    """Buckets of all subwords of a whole text."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    # Letters are ASCII letters and all bytes of other characters; the rest is a boundary.
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    keep = letter | np.concatenate([[True], letter[:-1]])  # one boundary for a run of them
    data = np.where(letter, data, 32)[keep].astype(np.uint32)
    found = []
    for n in LENGTHS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint32)
        gap = np.zeros(len(code), bool)
        for i in range(n):
            part = data[i : i + len(code)]
            code = (code ^ part) * _FACTORS[i % 3]
            code ^= code >> np.uint32(15)
            if 0 < i < n - 1:
                gap |= part == 32  # a boundary stands at the ends of a subword only
        found.append(code[~gap] % np.uint32(BUCKETS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Trained model. ``rows`` holds the layer applied to every row of the table."""

    languages: list[str]
    rows: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probabilities; the mean of embeddings under a linear layer is the mean of rows."""
        at = grams(text)
        counts = np.bincount(at, minlength=BUCKETS)
        logits = (counts @ self.rows / max(len(at), 1) + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def fit(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 2.0, seed: int = 7) -> Model:
    """Train on labelled texts; every fifth one is kept from training, for temperature and threshold."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    label = np.array([names.index(x) for x in languages])
    parts = [np.unique(grams(t), return_counts=True) for t in texts]
    parts = [(b.astype(np.int64), n / max(n.sum(), 1)) for b, n in parts]
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(texts))
    kept, train = (order[::5], np.setdiff1d(order, order[::5])) if len(texts) >= 50 else (order, order)
    table = draw.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    weight = len(label) / (len(names) * np.bincount(label, minlength=len(names)).clip(1))  # rare languages count as much
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in draw.permutation(train):
            b, share = parts[i]
            hidden = share @ table[b]
            logits = hidden @ layer + bias
            e = np.exp(logits - logits.max())
            error = e / e.sum()
            error[label[i]] -= 1
            step = rate * (1 - done / steps) * min(weight[label[i]], 5.0)
            done += 1
            back = layer @ error
            layer -= step * np.outer(hidden, error)
            bias -= 0.1 * step * error
            table[b] -= step * 4 * share[:, None] * back
    model = Model(names, table @ layer, bias)
    logits = np.array([np.bincount(b, weights=s, minlength=BUCKETS) @ model.rows + bias for b, s in (parts[i] for i in kept)])
    truth = label[kept]

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.05, 10, 60), key=loss)
    z = logits / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    # Half of the score that all but a small share of right answers reach, and at most an even split.
    model.threshold = float(min(np.quantile(right, REJECT_SHARE) / 2, 1 / len(names) + 0.1)) if len(right) else 0.0
    return model


def sample(labelled: DataFrame, id_column: str, text_column: str, lang_column: str,
           per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Bounded sample of labelled rows: the first by hash of id and text of each language, evenly shared out.

    A first pass counts the rows of each language; the second keeps those whose hash lies in the
    lowest part of its range, about three times the wanted number, so that few rows meet in the
    task that picks the first of a language.
    """
    text, lang = F.col(f"`{text_column}`"), F.col(f"`{lang_column}`")
    order = F.xxhash64(F.col(f"`{id_column}`"), text)
    rows = labelled.where(text.isNotNull() & lang.isNotNull()).select(lang.alias("lang"), text.alias("text"), order.alias("at"))
    counts = labelled.where(text.isNotNull() & lang.isNotNull()).groupBy(lang.alias("lang")).count()
    part = F.pmod("at", F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(F.broadcast(counts.orderBy(F.desc("count"), "lang").limit(most)), "lang").where(part <= 3.0 * per_language / F.col("count"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(part, "at", "text"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("rank", "at", "lang").limit(most).collect()
    return [r["text"] for r in chosen], [r["lang"] for r in chosen]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Language of every row by its whole text: all columns of ``docs`` and lang_pred, score, rejected.

    lang_pred is a learned language, or ``und`` (score 0) if the text is null or has no letter, or
    nothing was learned; score is the calibrated probability. rejected marks ``und`` and scores
    below the model's threshold. Ties go to the first language by name. Rows are taken one by one
    without a shuffle; an empty table gives no rows. A column that is already called like one of
    the three is replaced, others pass through.
    """
    added = "lang_pred string, score double, rejected boolean"
    rest = docs.drop("lang_pred", "score", "rejected")
    mark = fresh(rest, "__lettered")
    rows = rest.withColumn(mark, has_letter(F.col(f"`{text_column}`")))
    names = rest.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = [], []
        for text, lettered in zip(texts_of(batch, text_column), batch.column(mark).to_pylist(), strict=True):
            if lettered and model.languages:
                p = model.scores(text)
                best = int(p.argmax())
                lang.append(model.languages[best])
                score.append(float(p[best]))
            else:
                lang.append(UNDETERMINED)
                score.append(0.0)
        score = pa.array(score, pa.float64())
        out = pc.or_(pc.less(score, model.threshold), pc.equal(pa.array(lang, pa.string()), UNDETERMINED))
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), score, out], [*names, "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    return by_slices(rows, text_column, work, T.StructType([*rest.schema.fields, *T.StructType.fromDDL(added).fields]))
