"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words and the first letters they begin with (inflected words share them), pairs of neighbouring
words and pairs with one word between, each present or not, hashed to 2 ** BITS places. Training sees a bounded sample (``MAX_ROWS`` labelled rows in the order of a seeded hash of doc_id), each
row several times in a fixed order, in one task. Every coordinate has its own learning rate, and L1 keeps only coordinates
that have earned a weight; the few that remain are broadcast, at most 2 ** BITS of them.

Labels serve for training alone. Rows with a null label aren't used; a doc_id with several labels counts as toxic if one says so. Null
and empty texts have no features and score the base rate. Every row of ``docs`` is scored over its whole text. Without labelled
rows all scores are 0.5 and, as the contract counts 0.5 as toxic, so are the predictions of a caller who trains on nothing.
Repeated rows are scored each; texts of any length are read whole. The training task holds at most MAX_ROWS rows of 2 ** BITS places. An
empty table gives no rows. Columns other than doc_id and text, and the labels' doc_id and toxic, are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import arrow_rows, materialise, text_bytes
from sparkprep.llm.license_scan import words_of

BITS = 22
FOLDS = 5
#: Labelled rows that training reads at most.
MAX_ROWS = 10_000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.001
EPOCHS = 20
#: Letters of a word that count as its beginning; only longer words have one.
BEGINNING = 4
SEED = 42
#: Features of fewer training rows are left out: they can't earn a weight that holds for other rows.
SEEN = 3
#: Words whose hashes a task keeps at hand.
KNOWN = 100_000


class Features:
    """The distinct hashed features of texts; the hashes of words are kept, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begins: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64)
        known, begins, different = self.known, self.begins, set(words)
        for word in different.difference(known):
            known[word] = xxhash.xxh64_intdigest(word, SEED)
            letters = word.decode("utf-8", "replace")
            begins[word] = xxhash.xxh64_intdigest(letters[:BEGINNING].encode(), SEED + 1) if len(letters) > BEGINNING else known[word]
        h = np.array([known[w] for w in words], np.uint64)
        starts = np.array([begins[w] for w in different], np.uint64)
        if len(known) > KNOWN:
            known.clear()
            begins.clear()
        mixed = lambda a, b, k: ((a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(31))) + b * np.uint64(2 * k + 0xC2B2AE3D27D4EB4F)
        pairs, skips = mixed(h[:-1], h[1:], 1), mixed(h[:-2], h[2:], 2)
        values = np.concatenate([h, starts, pairs, skips])
        return np.unique(((values ^ (values >> np.uint64(32))) & np.uint64((1 << BITS) - 1)).astype(np.int64))


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (features, label) rows, in their order: the weights, and the bias (which L1 leaves alone)."""
    size = 1 << BITS
    seen = np.zeros(size, np.int64)
    for features, _ in rows:
        seen[features] += 1
    kept = np.flatnonzero(seen >= SEEN)
    dense = np.cumsum(seen >= SEEN) - 1
    rows = [(np.append(dense[features[seen[features] >= SEEN]], len(kept)), label) for features, label in rows]
    z, n = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    shrink = np.full(len(kept) + 1, L1)
    shrink[-1] = 0.0  # the bias

    def weights(z: np.ndarray, root: np.ndarray, shrink: np.ndarray) -> np.ndarray:
        over = np.maximum(np.abs(z) - shrink, 0.0)
        return -np.copysign(over, z) / ((BETA + root) / ALPHA + L2)

    for _ in range(epochs):
        for at, label in rows:
            own, count = z[at], n[at]
            root = np.sqrt(count)
            w = weights(own, root, shrink[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            count += g * g
            z[at] = own + g - (np.sqrt(count) - root) / ALPHA * w
            n[at] = count
    out = np.zeros(size)
    w = weights(z, np.sqrt(n), shrink)
    out[kept] = w[:-1]
    return out, float(w[-1])


def in_training(doc_id: str = "doc_id") -> F.Column:
    """Whether labels of a doc_id may be learnt from; those of a null one may not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS != 0, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The places of the weights that L1 left, the weights, and the bias."""
    known = labels.where("toxic is not null and doc_id is not null").where(in_training()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = materialise(known.withColumn("r", F.xxhash64("doc_id", F.lit(SEED))).orderBy("r").limit(max_rows), "sample")
    # At most max_rows rows of three numbers.
    texts = docs.select(F.col("doc_id").cast("long"), text_bytes()).join(F.broadcast(chosen), "doc_id").select("doc_id", "r", F.col("toxic").cast("int"), "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in arrow_rows(batches):
            found = [features.of(x).astype(np.int32) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "r", "toxic", "features"])

    rows = materialise(texts.mapInArrow(described, "doc_id long, r long, toxic int, features array<int>"), "features")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), [x.values.to_numpy().astype(np.int64) for x in b.column(3)])]
        rows.sort(key=lambda x: (x[0], x[1]))
        weights, bias = train([(x[3], x[2]) for x in rows])
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([weights[at].tolist()], pa.list_(pa.float64())), pa.array([bias])], ["places", "weights", "bias"])

    found = rows.coalesce(1).mapInArrow(fit, "places array<long>, weights array<double>, bias double").first()
    return (np.array(found[0], np.int64), np.array(found[1]), found[2]) if found else (np.zeros(0, np.int64), np.zeros(0), 0.0)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``."""
    places, values, bias = model(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, features = np.zeros(1 << BITS), Features()
        weights[places] = values
        for batch in arrow_rows(batches):
            sums = np.array([bias + weights[features.of(x)].sum() for x in batch.column(1).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", "predicted")
