"""Document quality by pairwise ranking.

A document's score is linear in features of its whole text: how much of it is
repeated, shouted, symbols, digits or line breaks, how long words and lines
are, and so on, each also cut into steps at the labelled rows' quantiles.
Weights come from a Bradley-Terry model: in a pair of a good and a bad document
the good one wins with probability sigmoid(score difference), and the mean
logistic loss over all pairs is minimised by Newton's method.  The cut is the
quantile of the labelled rows' scores at the share of bad documents; scores are
moved so that the cut becomes ``AT_CUT`` after the logistic function.

All labelled rows are learned from, and all pairs of a good and a bad one.
Their features are written once; each pass over them gives sums by task, whose
size does not depend on the rows.  For these sums a score counts by its place on
a grid of ``GRID`` places, shared linearly by the two around it, so that pairs
are counted by places; for quantiles a feature keeps the first ``BITS`` bits of
its fraction.  Scoring reads every document once.

Cases: null and empty texts have the features of no words and get their score
like any other; labels that are null or for unknown documents teach nothing;
with labels of one kind only every score is the kind's; repeated rows are each
scored; rows with a null ``doc_id`` are scored but not learned from; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, release
from .text import blocks, shingles, utf8, words

#: What all pairs weigh together against ``PENALTY``.
PAIRS = 60_000
STEPS = 12
PENALTY = 1.0
#: Places of scores, bits of a feature's fraction, most tasks of a pass and most rows that are expanded at a time.
GRID, BITS, TASKS, ROWS = 256, 10, 24, 4096
#: Passes of Newton's method at most, and the change of a weight at which it ends.
PASSES, SMALL = 12, 1e-4
#: The score of a document right at the cut.
AT_CUT = 0.3

_CLASS = np.zeros(256, np.int64)  # 1 upper case, 2 lower case, 3 digit, 4 sentence mark, 5 exclamation, 6 bar, 7 other symbol, 8 newline, 9 blank, 10 beyond ASCII
_CLASS[0x21:0x7F] = 7
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
_CLASS[[0x0A, 0x0D]], _CLASS[[0x20, 0x09]], _CLASS[0x80:] = 8, 9, 10
_KINDS = 11

FEATURES = ("log_words", "word_bytes", "line_words", "distinct", "top_share", "echo", "distinct3", "upper", "digit", "mark", "shout", "bar", "symbol", "control", "beyond", "long_word", "hex_run")


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each document of a block."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    who = np.repeat(np.arange(n), size)
    kind = np.bincount(who * _KINDS + _CLASS[raw], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    h, at = words(raw, offsets)
    s, s_at = shingles(h, at, 3)
    count = np.diff(at)
    distinct, top, distinct3 = np.ones(n), np.zeros(n), np.ones(n)
    for d in np.flatnonzero(count):
        value = np.sort(h[at[d] : at[d + 1]])
        edges = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
        distinct[d] = (len(edges) - 1) / count[d]
        top[d] = np.diff(edges).max() / count[d]
        own = s[s_at[d] : s_at[d + 1]]
        distinct3[d] = len(np.unique(own)) / len(own)
    same = np.concatenate(([0], np.cumsum(h[1:] == h[:-1]))) if len(h) else np.zeros(1, np.int64)
    echo = np.zeros(n)
    some = count > 1
    echo[some] = (same[at[1:][some] - 1] - same[at[:-1][some]]) / (count[some] - 1)
    n_words, n_bytes = np.maximum(count, 1), np.maximum(size, 1)
    letters = np.maximum(kind[:, 1] + kind[:, 2] + kind[:, 10], 1)
    lines = kind[:, 8] + 1
    body = n_bytes - kind[:, 8] - kind[:, 9]
    cols = [
        np.log1p(count), body / n_words, np.log1p(count / lines), distinct, top, echo, distinct3,
        kind[:, 1] / letters, kind[:, 3] / n_bytes, kind[:, 4] / n_words, kind[:, 5] / n_words, kind[:, 6] / n_words,
        kind[:, 7] / n_words, kind[:, 0] / n_bytes, kind[:, 10] / n_bytes, kind[:, 10] / letters, kind[:, 3] / n_words,
    ]
    return np.column_stack(cols)


def feature_rows(column: pa.Array) -> np.ndarray:
    raw, offsets = utf8(column)
    parts = [features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    cuts: np.ndarray  # feature x step
    weights: np.ndarray
    shift: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and their steps."""
        steps = x[:, :, None] > self.cuts[None, :, :]
        return np.concatenate(((x - self.mean) / self.scale, steps.reshape(len(x), -1)), axis=1)

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_score(x) + self.shift, -500, 500)))


def rounded(x: np.ndarray) -> np.ndarray:
    """Doubles cut to ``BITS`` bits of their fraction."""
    return (np.ascontiguousarray(x, "<f8").view("<i8") >> (52 - BITS) << (52 - BITS)).view("<f8")


def tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which feature, which rounded value, and how many rows have it."""
    found = [np.unique(rounded(x[:, k]), return_counts=True) for k in range(x.shape[1])]
    return np.repeat(np.arange(len(found)), [len(v) for v, _ in found]), np.concatenate([v for v, _ in found]), np.concatenate([n for _, n in found])


def quantile(value: np.ndarray, count: np.ndarray, at: np.ndarray | float) -> np.ndarray:
    """As ``numpy.quantile`` of values that occur ``count`` times."""
    order = np.argsort(value)
    value, last = value[order], np.cumsum(count[order]) - 1
    place = np.asarray(at) * last[-1]
    low, high = (value[np.searchsorted(last, f(place))] for f in (np.floor, np.ceil))
    return low + (high - low) * (place - np.floor(place))


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, bad rows, and sums of the features and of their squares."""
    return np.concatenate(([len(x), (y == 0).sum()], x.sum(0), (x * x).sum(0)))


def extremes(model: Model, x: np.ndarray) -> np.ndarray:
    """Minus the least and the greatest score."""
    s = model.raw_score(x) if len(x) else np.array([0.0])
    return np.array([-s.min(), s.max()])


def on_grid(model: Model, x: np.ndarray, y: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    """Bad and good rows and sums of their expanded features at each place of scores between ``ends``."""
    out = np.zeros((2, GRID, len(model.weights) + 1))
    for first in range(0, len(x), ROWS):
        z, label = model.expand(x[first : first + ROWS]), y[first : first + ROWS].astype(int)
        place = np.clip((z @ model.weights - ends[0]) / max(ends[1] - ends[0], 1e-9), 0, 1) * (GRID - 1)
        low = np.minimum(place.astype(int), GRID - 2)
        one = np.column_stack((np.ones(len(z)), z))
        key = label * GRID + low
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        at = key[order][starts]
        for k, share in ((at, low + 1 - place), (at + 1, place - low)):
            out.reshape(2 * GRID, -1)[k] += np.add.reduceat((one * share[:, None])[order], starts, axis=0)
    return out


def squares(model: Model, x: np.ndarray, y: np.ndarray, ends: tuple[float, float], own: np.ndarray) -> np.ndarray:
    """The expanded features' products, each row weighed by ``own`` (label x place) at its score."""
    at, out = np.linspace(*ends, GRID), np.zeros((len(model.weights),) * 2)
    for first in range(0, len(x), ROWS):
        z, label = model.expand(x[first : first + ROWS]), y[first : first + ROWS]
        s = z @ model.weights
        weight = np.where(label == 1, np.interp(s, at, own[1]), np.interp(s, at, own[0]))
        out += z.T @ (z * weight[:, None])
    return out


def newton(grid: np.ndarray, ends: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From rows and sums by place: the loss's gradient, each place's weight, and the part of the curvature between unlike rows."""
    (bad, good), (bad_z, good_z) = grid[:, :, 0], grid[:, :, 1:]
    at = np.linspace(*ends, GRID)
    lost = 1 / (1 + np.exp(np.clip(at[:, None] - at[None, :], -500, 500)))  # that a good one at the row does not win against a bad one at the column
    each = PAIRS / (good.sum() * bad.sum())
    gradient = each * ((lost @ bad) @ good_z - (good @ lost) @ bad_z)
    both = lost * (1 - lost)
    cross = good_z.T @ both @ bad_z
    return gradient, each * np.stack((good @ both, both @ bad)), each * (cross + cross.T)


def at_ends(y: float) -> Model:
    """Of labels of one kind only."""
    k = len(FEATURES)
    return Model(np.zeros(k), np.ones(k), np.full((k, STEPS), np.inf), np.zeros(k * (STEPS + 1)), 20.0 if y else -20.0)


def learn(total: Callable[..., np.ndarray | None], tallied: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """Bradley-Terry weights.

    ``total(f, op)`` is the sum (or by ``op`` the maximum) of f(x, y) over parts of the labelled rows, None without any;
    ``tallied(f)`` adds up the counts of f(x, y), as ``tally`` gives them.
    """
    sums, k = total(moments), len(FEATURES)
    n, bad = (0, 0) if sums is None else sums[:2]
    if bad in (0, n):
        return at_ends(float(bad == 0))
    mean = sums[2 : 2 + k] / n
    scale = np.sqrt(np.maximum(sums[2 + k :] / n - mean * mean, 0))
    feature, value, count = tallied(lambda x, y: tally(x))
    cuts = np.stack([quantile(value[own], count[own], np.linspace(0, 1, STEPS + 2)[1:-1]) for own in (feature == j for j in range(k))])
    model = Model(mean, np.where(scale > 1e-6 * np.abs(mean), scale, 1), cuts, np.zeros(k * (STEPS + 1)), 0.0)
    for _ in range(PASSES):
        low, high = total(lambda x, y: extremes(model, x), np.maximum) * (-1, 1)
        ends = (float(low), float(high))
        gradient, own, cross = newton(total(lambda x, y: on_grid(model, x, y, ends)), ends)
        hessian = total(lambda x, y: squares(model, x, y, ends, own)) - cross + PENALTY * np.eye(len(gradient))
        step = np.linalg.solve(hessian, gradient - PENALTY * model.weights)
        model = replace(model, weights=model.weights + step)
        if np.abs(step).max() < SMALL:
            break
    _, value, count = tallied(lambda x, y: tally(model.raw_score(x)[:, None]))
    return replace(model, shift=float(np.log(AT_CUT / (1 - AT_CUT)) - quantile(value, count, bad / n)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Bradley-Terry weights from features and 0/1 labels."""
    return learn(lambda f, op=np.add: f(x, y) if len(x) else None, lambda f: f(x, y))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype("<f8").tobytes() for r in feature_rows(batch.column(1))], pa.binary())], ["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).where("doc_id is not null")
    rows = texts.mapInArrow(run, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))  # features move, texts do not
    made = durable(rows.join(known, "doc_id").select("y", "x"), "quality-features")
    few = made.coalesce(TASKS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                yield np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(-1, len(FEATURES)), batch.column(0).to_numpy()

    def total(f: Callable, op: np.ufunc = np.add) -> np.ndarray | None:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = None
            for x, y in read(batches):
                own = f(x, y)
                v = own if v is None else op(v, own)
            if v is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f8").tobytes()], pa.binary()), pa.array([list(v.shape)], pa.list_(pa.int64()))], ["v", "shape"])

        found = few.mapInArrow(part, "v binary, shape array<long>").collect()  # a row a task
        return reduce(op, (np.frombuffer(r["v"], "<f8").reshape(r["shape"]) for r in found)) if found else None

    def tallied(f: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y in read(batches):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in f(x, y)], ["f", "v", "n"])

        table = few.mapInArrow(part, "f long, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow()
        return tuple(table[c].to_numpy() for c in ("f", "v", "n"))

    model = learn(total, tallied)
    release(made)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(feature_rows(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
