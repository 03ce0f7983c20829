"""Quality classifier: hashed word n-gram logistic regression, trained by follow the regularised leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeparts.llm.common import cut, fold, training_rows, worker_cache

FOLDS, HELD = 5, 0
THRESHOLD = 0.3
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_384
#: Weights: 2 ** BITS.
BITS = 18
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.3, 1.0, 0.02, 1.0
#: Words whose hashes a worker keeps.
KEPT_WORDS = 400_000

REPEATED = np.uint64(0xA0761D6478BD642F)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Slots of the words and of the pairs of neighbouring words; case and punctuation count, as junk shows there.

    A word twice in a row is the same pair, whatever the word.
    """
    cache = worker_cache("quality")
    hashes = cache.get("hashes") or cache.setdefault("hashes", _Hashes())
    tokens = TOKEN.findall(text or "")
    one = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = np.where(one[:-1] == one[1:], REPEATED, pairs ^ (pairs >> np.uint64(29)))
    both = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), pairs])
    return (both >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: Iterator[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates, one document at a time; a slot counts 1/sqrt(slots of the text)."""
    rows = list(rows)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = 0.0
    bias = 0.0
    for _ in range(EPOCHS):
        for slots, label in rows:
            at, times = np.unique(slots, return_counts=True)
            x = times / np.sqrt(max(len(slots), 1))
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            bias = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            error = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - label
            g = error * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] += g * g
            bz += error - (np.sqrt(bn + error * error) - np.sqrt(bn)) / ALPHA * bias
            bn += error * error
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), float(bias)


def score(slots: np.ndarray, weights: np.ndarray, bias: float) -> float:
    total = float(weights[slots].sum(dtype=np.float64)) / np.sqrt(max(len(slots), 1)) + bias
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the model, from all rows of the sample in the order of their hash."""
    rows = [(k, features(t), y) for b in batches for k, t, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
    if not rows:
        return
    rows.sort(key=lambda r: r[0])
    weights, bias = train((x, y) for _, x, y in rows)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model of at most ``sample`` labelled documents outside the held-out fold; 2 ** BITS weights.

    The sample is read by one task, which keeps its memory bounded by ``sample``. Without any label
    the model is neutral: it gives 0.5 to every text.
    """
    rows = cut(training_rows(docs, labels, "quality", FOLDS, HELD, sample))
    model = (
        rows.select(F.xxhash64("doc_id", "text").alias("k"), "text", "label")
        .coalesce(1)
        .mapInArrow(_train_batches, "weights binary, bias double")
        .collect()
    )
    if not model:
        return np.zeros(1 << BITS, dtype=np.float32), 0.0
    return np.frombuffer(model[0].weights, dtype=np.float32), model[0].bias


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, any others).

    A null text scores as an empty one, whose score is that of the bias alone. Repeated rows and
    equal texts get equal scores. No rows give no rows.
    """
    return _scored(docs.select("doc_id", "text"), fit(docs, labels, sample)).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` and a column ``score``; ``docs`` has a column ``text`` and none of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            texts = batch.column(names.index("text"))
            values = [score(features(t.as_py()), weights, bias) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", score double")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score at least THRESHOLD, with their columns; order, ties and copies as they are."""
    names = docs.columns
    numbered = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(names)])
    kept = _scored(numbered, fit(docs, labels, sample)).where(F.col("score") >= THRESHOLD).drop("score")
    return kept.toDF(*names)
