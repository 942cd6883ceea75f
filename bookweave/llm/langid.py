"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters are hashed to DIM features. Document frequencies are counted
over all rows that may be learned from. Weights are trained by follow-the-regularised-leader
with L1 and L2 penalties on a bounded sample, and a temperature is fitted on a part of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 1 << 14
#: Expected rows per language that the weights are fitted on; of these, one in CALIBRATE serves the temperature.
SAMPLE_PER_LANGUAGE = 500
CALIBRATE = 5
#: Share of a held-out row's probability that the temperature leaves to the languages in all,
#: so that rows that are all told right do not drive it to certainty.
SMOOTHING = 0.01
#: An n-gram is common if at least one in RARE of the learned texts has it.
RARE = 1000
#: Most languages that a model is fitted for.
MAX_LANGUAGES = 1000
#: Characters of a text that are hashed at once.
PIECE = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text, in rising order, and how often each occurs.

    The text is lower-cased; digits count as one character, so numbers weigh little.
    """
    total = np.zeros(DIM, dtype=np.int64)
    text = text.lower()
    for a in range(0, len(text), PIECE):
        c = np.frombuffer(text[a : a + PIECE + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.where((c >= 48) & (c < 58), np.uint32(48), c)
        n = min(PIECE, len(c))
        one = c * _M1
        grams = [one[:n]]
        if len(c) > 1:
            two = (one[:-1] ^ (c[1:] * _M2 + np.uint32(0x27D4EB2F))) * _M3
            grams.append(two[:n])
            if len(c) > 2:
                grams.append(((two[:-1] ^ (c[2:] * _M1 + np.uint32(0x165667B1))) * _M2)[:n])
        for h in grams:
            total += np.bincount((h ^ (h >> np.uint32(15))) * _M1 >> np.uint32(18), minlength=DIM)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """Weights by feature and language, inverse document frequencies, the temperature, and which features are common."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    common: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its calibrated probability, and how familiar the text is: the share of its n-grams that are common where the model learned.

        `und` and 0 for a text that is null or has no letter. Other scripts and junk fall
        on features at random, few of which are common.
        """
        at, n = counts(text or "")
        familiar = float(n[self.common[at]].sum() / n.sum()) if len(n) else 0.0
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, familiar
        x = (1 + np.log(n)) * self.idf[at]
        norm = math.sqrt(float(x @ x))
        p = softmax((x @ self.weights[at] / (norm or 1.0) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), familiar


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, classes) and biases of FTRL-proximal over rows of (features, values, class).

    Per coordinate z sums gradients less the pull of past weights and n squared gradients;
    a weight is zero while |z| <= l1. The bias has no penalty.
    """
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    penalty = np.full((DIM + 1, 1), l1)
    ridge = np.full((DIM + 1, 1), l2)
    penalty[DIM] = ridge[DIM] = 0

    def solve(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= penalty[at], 0.0, -(zz - np.sign(zz) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + ridge[at]))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = solve(slice(None))
    return w[:DIM], w[DIM]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss against smoothed labels, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    target = np.full(logits.shape, SMOOTHING / logits.shape[1])
    target[np.arange(len(labels)), labels] += 1 - SMOOTHING

    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))
        return float(-(target * np.log(p + 1e-12)).sum(axis=1).mean())

    a, b, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id") -> Model:
    """A model from the rows of docs whose lang and text are not null.

    Document frequencies come from all these rows, as DIM sums. The weights come from a
    bounded sample: each language's rows are taken at the rate that gives
    SAMPLE_PER_LANGUAGE of them on average, chosen by a hash of row_id, all where there
    are fewer. row_id decides on the sample only. No rows give a model that answers `und`.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}  # a row per language
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros(DIM), np.zeros((DIM, 0)), np.zeros(0), 1.0, np.zeros(DIM, dtype=bool))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIM, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[counts(t)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["feature", "n"])

    total = sum(sizes.values())
    df = np.zeros(DIM)
    for r in rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # DIM rows
        df[r.feature] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1

    share = F.element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / v)))), F.col("lang"))
    spot = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1_000_003)) / 1_000_003

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), batch.column(2)],
                names=["id", "at", "n", "lang"],
            )

    sample = rows.where(spot < share).mapInArrow(featurise, f"id {rows.schema['id'].dataType.simpleString()}, at array<long>, n array<long>, lang string")
    taken = sorted(sample.collect(), key=lambda r: (r.id is None, r.id, r.lang, r.at))  # about SAMPLE_PER_LANGUAGE rows per language
    languages = sorted(sizes)
    label = {k: i for i, k in enumerate(languages)}
    points = []
    for r in taken:
        at, x = np.array(r.at, dtype=np.int64), (1 + np.log(np.array(r.n, dtype=float))) * idf[r.at]
        norm = math.sqrt(float(x @ x))
        points.append((at, x / norm if norm else x, label[r.lang]))
    fit = [p for i, p in enumerate(points) if i % CALIBRATE or len(points) < 4 * CALIBRATE]
    held = [p for i, p in enumerate(points) if i % CALIBRATE == 0 and len(points) >= 4 * CALIBRATE]
    weights, bias = ftrl(fit, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, np.array([c for _, _, c in held], dtype=np.int64)), (df > 0) & (df * RARE >= total))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and familiar of each whole text, from the text alone.

    Null texts and texts without a letter get `und` and score 0. familiar is the share of
    n-grams that are common in the learned texts: low for other scripts and junk, whatever
    their score, which only weighs the learned languages against each other. Columns of the three names
    are replaced, all others and repeated rows stay. The model is broadcast: DIM weights
    for each of at most MAX_LANGUAGES languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score", "familiar")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("familiar", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            made = [held.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.float64()) for k in (1, 2))],
                names=[*batch.schema.names, "lang_pred", "score", "familiar"],
            )

    return rest.mapInArrow(run, schema)


def held_out(row_id: str = "doc_id"):
    """True for the quarter of documents that is never learned from; false where row_id is null."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % 4 == 2, F.lit(False))
