"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are hashed words, word pairs, pairs with one word between them, and
the first bytes of words, which catch inflected forms; each counts once in a
document.  Weights are learned by follow-the-regularised-leader with a learning
rate for each coordinate; its L1 term leaves most weights at exactly 0, and
only the others go to the executors, where a document's score is the logistic
function of the sum of its features' weights.

At most ``SAMPLE`` labelled rows of either label are learned from, picked by a
hash of their id, with ``FEATURES`` features at most (4 bytes each on the driver); of
several texts under a ``doc_id`` the first in order is learned from.  Scoring reads every document once.

Cases: null and empty texts have no features and the score of the bias alone;
labels that are null or for unknown documents teach nothing; without labels
every score is 0.5; repeated rows are each scored; rows with a null ``doc_id``
are scored but not learned from; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, release
from .text import blocks, hash_words, mix, utf8, word_spans

#: Most labelled rows of either label, passes over them, and bits of a feature's number.
SAMPLE, PASSES, BITS = 3000, 5, 20
#: Most features of all sampled documents together; in the order of the hash, documents beyond are not learned from.
FEATURES = 40_000_000
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
STEMS = (4, 6)
_SALT = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x8EBC6AF09C88C6E3], np.uint64)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the document of each, with repeats."""
    starts, ends = word_spans(raw, offsets)
    h = hash_words(raw, starts, ends)
    who = np.searchsorted(offsets, starts, "right") - 1
    made = [(h * _SALT[0], who)]
    for salt, stem in zip(_SALT[1:], STEMS):
        made.append((hash_words(raw, starts, np.minimum(ends, starts + stem)) * salt, who))
    for gap in (1, 2):
        pair = mix(h[:-gap] * _SALT[2 + gap]) + h[gap:] if len(h) > gap else h[:0]
        inside = who[:-gap] == who[gap:] if len(h) > gap else np.zeros(0, bool)
        made.append((pair[inside], who[:-gap][inside] if len(h) > gap else who[:0]))
    number = np.concatenate([mix(x) >> np.uint64(64 - BITS) for x, _ in made]).astype(np.int64)
    return number, np.concatenate([w for _, w in made])


def distinct(number: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((who << BITS) | number)
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass
class Model:
    index: np.ndarray  # features with a weight, ascending
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float64)
        out[self.index] = self.weight
        return out


def ftrl(docs: list[np.ndarray], y: np.ndarray, passes: int = PASSES) -> Model:
    """Weights from each document's distinct features, in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for own, label in zip(docs, y):
            at = np.append(own, size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    index = np.flatnonzero(w[:size])
    return Model(index, w[index], float(w[size]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(sample).unionAll(known.where("y = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            out: list[bytes] = []
            for a, b in blocks(offsets):
                number, who = distinct(*features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                at = np.searchsorted(who, np.arange(b - a + 1))
                out += [number[at[d] : at[d + 1]].astype("<i4").tobytes() for d in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "x"])

    made = durable(rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary"), "toxic-features")
    held, used = [], 0
    for r in made.select("doc_id", "y", F.length("x").alias("size")).orderBy(*order, "y").collect():  # 2 * sample rows at most
        used += r["size"] // 4
        if used <= FEATURES:
            held.append((r["doc_id"], r["y"]))
    if used > FEATURES:
        made = made.join(F.broadcast(docs.sparkSession.createDataFrame(held, "doc_id long, y int")), ["doc_id", "y"])
    found = made.select("doc_id", "y", "x").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    release(made)
    x = [np.frombuffer(v, "<i4") for v in found["x"].to_pylist()]
    y = found["y"].to_numpy()
    mixed = np.random.default_rng(3).permutation(len(x))
    return ftrl([x[i] for i in mixed], y[mixed])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = model.dense()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            total = np.full(batch.num_rows, model.bias)
            for a, b in blocks(offsets):
                number, who = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                with_weight = weight[number] != 0
                number, who = distinct(number[with_weight], who[with_weight])
                total[a:b] += np.bincount(who, weight[number], b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
