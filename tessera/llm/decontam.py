"""Benchmark decontamination by SimHash windows and exact weighted similarity.

Benchmark items are taken in blocks of bounded size; each block's model goes to
the executors, which read the documents once per block.  A model holds the
items' word shingles with weights ln(1 + items / items that have it), counted
over the whole benchmark, their
64-bit SimHashes, and an index of these by 8-bit parts: two fingerprints within
``radius`` differ in at most ``radius // 8`` bits of some part, so looking up
every value that near in each part finds all of them.

Windows of an item's size (sizes are taken in steps of about 5 %) slide over
every document by one word; at its end they are cut, so that a passage shorter
than its step is met at its own start.  A window cannot be similar to an item unless the
shingles that it has from any item make up most of its weight, so others are
passed over (``SLACK`` allows for the steps in size).  Items within the radius of a
window are verified there: the weighted Jaccard similarity of the item's
shingles and of the window of exactly the item's size must reach
``similarity``.

Cases: null and empty texts and items match nothing; an item of fewer words
than a shingle has its whole sequence as one; repeated documents are each
reported; items that repeat an ``item_id`` are separate items whose best match
counts; an empty table on either side gives no matches; null ids are kept as
they are; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks, mix, shingles, utf8, words

#: Most items and characters in a block of items.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
RADIUS = 18
#: Shingles of a dense passage that are looked at together, besides the widest windows.
PIECE = 50_000
PARTS = 8
GATE_BITS = 20
SLACK = 0.15
_BITS = np.arange(64, dtype=np.uint64)


@dataclass
class Item:
    item_id: int | None
    n_words: int
    size: int  # of its windows for SimHash
    shingles: np.ndarray  # distinct, ascending
    counts: np.ndarray
    total: float


class Model:
    """What executors need of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, radius: int, shared: tuple[int, np.ndarray, np.ndarray] | None = None) -> None:
        self.n, self.radius = n, radius
        raw, offsets = utf8(pa.array([x for _, x in items], pa.large_string()))
        h, at = words(raw, offsets)
        s, s_at = shingles(h, at, n)
        own = [np.unique(s[s_at[i] : s_at[i + 1]], return_counts=True) for i in range(len(items))]
        self.known, df = np.unique(np.concatenate([x for x, _ in own]) if own else np.empty(0, np.uint64), return_counts=True)
        total, self.rated, df = shared or (len(items), self.known[df > 1], df[df > 1])
        self.weight = np.log(1 + total / df)
        self.unknown = float(np.log(1 + total))  # also of shingles that one item has
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[self.known >> np.uint64(64 - GATE_BITS)] = True
        self.items: list[Item] = []
        for (item_id, _), (value, count), n_words in zip(items, own, np.diff(at)):
            if n_words:
                size = int(n_words) if n_words <= 2 * n else int(round(1.05 ** round(np.log(n_words) / np.log(1.05))))
                self.items.append(Item(item_id, int(n_words), size, value, count, float((self.weights(value) * count).sum())))
        self.prints = np.array([self.simhash(np.repeat(x.shingles, x.counts)) for x in self.items], np.uint64)
        self.sizes = sorted({x.size for x in self.items})
        step = {size: i for i, size in enumerate(self.sizes)}
        self.step = np.array([step[x.size] for x in self.items], np.int64)
        self.fewest = [size if size <= 2 * n else int((size - 0.5) / 1.05**0.5) for size in self.sizes]  # words of a step's shortest item
        spread = radius // PARTS
        ball = np.array([x for x in range(256) if bin(x).count("1") <= spread], np.int64)
        # for each part: items under (size, value), for every value within the spread of theirs
        self.index: list[tuple[np.ndarray, np.ndarray]] = []
        for p in range(PARTS):
            value = ((self.prints >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
            key = (self.step[:, None] * 256 + (value[:, None] ^ ball[None, :])).ravel()
            order = np.argsort(key, kind="stable")
            self.index.append((np.searchsorted(key[order], np.arange(256 * len(self.sizes) + 1)), order // len(ball)))

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Where shingles of items are: a bitmap passes over most others."""
        hit = np.flatnonzero(self.gate[s >> np.uint64(64 - GATE_BITS)])
        return hit[self.known[np.minimum(np.searchsorted(self.known, s[hit]), len(self.known) - 1)] == s[hit]] if len(hit) else hit

    def weights(self, value: np.ndarray) -> np.ndarray:
        if not len(self.rated):
            return np.full(len(value), self.unknown)
        at = np.minimum(np.searchsorted(self.rated, value), len(self.rated) - 1)
        return np.where(self.rated[at] == value, self.weight[at], self.unknown)

    def votes(self, value: np.ndarray) -> np.ndarray:
        bits = (mix(value)[:, None] >> _BITS) & np.uint64(1)
        return np.where(bits == 1, 1.0, -1.0) * self.weights(value)[:, None]

    def simhash(self, value: np.ndarray) -> np.uint64:
        return pack_bits(self.votes(value).sum(0)[None, :])[0]

    def near(self, step: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of a window's size within the radius of its fingerprint."""
        pairs = []
        for p, (at, items) in enumerate(self.index):
            key = step * 256 + ((windows >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
            count = at[key + 1] - at[key]
            who = np.repeat(np.arange(len(windows)), count)
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[key], count)
            pairs.append(who * len(self.items) + items[place])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.items), pair % len(self.items)
        near = np.bitwise_count(self.prints[item] ^ windows[window]) <= self.radius
        return window[near], item[near]

    def similarity(self, item: Item, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's and a window's shingles."""
        value, count = np.unique(window, return_counts=True)
        weight = self.weights(value)
        at = np.minimum(np.searchsorted(item.shingles, value), len(item.shingles) - 1)
        common = np.where(item.shingles[at] == value, np.minimum(item.counts[at], count), 0)
        shared = float((common * weight).sum())
        return shared / (item.total + float((count * weight).sum()) - shared)


def pack_bits(votes: np.ndarray) -> np.ndarray:
    return ((votes > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def matches(model: Model, hashes: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int]]:
    """Best verified window of each item in one document: similarity, first word, words."""
    best: dict[int, tuple[float, int, int]] = {}
    for short in sorted({min(size, model.n) for size in model.sizes}):
        if len(hashes) < short:
            continue
        s, _ = shingles(hashes, np.array([0, len(hashes)]), short)
        if short < model.n:  # whole sequences of few words
            s = mix_short(hashes, short)
        hit = model.hits(s)
        if not len(hit):
            continue
        reach = max(size for size in model.sizes)
        ends = np.flatnonzero(np.diff(hit) > 2 * reach)
        for low, high in _pieces(hit[np.concatenate(([0], ends + 1))], hit[np.concatenate((ends, [len(hit) - 1]))], reach, len(s)):
            own = s[low:high]
            votes = model.votes(own)
            weight = np.abs(votes[:, 0])
            total = np.concatenate((np.zeros((1, 64)), np.cumsum(votes, 0)))
            all_weight = np.concatenate(([0], np.cumsum(weight)))
            hit_weight = np.concatenate(([0], np.cumsum(weight * np.isin(own, model.known))))
            begin, end, which = [], [], []
            for step, size in enumerate(model.sizes):
                if min(size, model.n) != short:
                    continue
                wide = min(size - short + 1, len(own))  # shingles of a window; of the document if that is shorter
                least = min(model.fewest[step] - short + 1, wide)  # an item below the step's size may end the text
                starts = np.arange(len(own) - least + 1)
                stops = np.minimum(starts + wide, len(own))
                kept = hit_weight[stops] - hit_weight[starts] >= (similarity - SLACK) * (all_weight[stops] - all_weight[starts])
                starts, stops = starts[kept], stops[kept]
                begin.append(starts)
                end.append(stops)
                which.append(np.full(len(starts), step))
            starts, stops, steps = (np.concatenate(x) for x in (begin, end, which))
            if not len(starts):
                continue
            for w, i in zip(*model.near(steps, pack_bits(total[stops] - total[starts]))):
                item = model.items[i]
                width = item.n_words - short + 1
                start = max(0, min(int(starts[w]), len(own) - width))
                exact = own[start : start + width]
                value = model.similarity(item, exact)
                if value >= similarity and value > best.get(i, (0.0,))[0]:
                    best[i] = (value, low + start, len(exact) + short - 1)
    return best


def _pieces(first: np.ndarray, last: np.ndarray, reach: int, size: int) -> Iterator[tuple[int, int]]:
    """Ranges around hits, of bounded length: neighbours overlap by more than any window."""
    for a, b in zip(first.tolist(), last.tolist()):
        low, high = max(0, a - reach), min(size, b + reach + 1)
        while high - low > PIECE + 2 * reach:
            yield low, low + PIECE + 2 * reach
            low += PIECE
        yield low, high


def mix_short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Every run of ``n`` words as a document of its own would have it as its one shingle."""
    runs = np.lib.stride_tricks.sliding_window_view(hashes, n)
    at = np.arange(len(runs) + 1) * n
    return shingles(runs.reshape(-1), at, n + 1)[0]


RESULT = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _found(model: Model, column: pa.Array, similarity: float) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """(row, matches) of the texts that have any."""
    raw, offsets = utf8(column)
    whole = all(min(size, model.n) == model.n for size in model.sizes)
    for a, b in blocks(offsets):
        h, at = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        which = np.arange(b - a)
        if whole:  # documents without any item's shingle match nothing
            s, s_at = shingles(h, at, model.n)
            which = np.unique(np.searchsorted(s_at, model.hits(s), "right") - 1)
        for d in which:
            if best := matches(model, h[at[d] : at[d + 1]], similarity):
                yield a + int(d), best


def _search(docs: DataFrame, model: Model, similarity: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, best in _found(model, batch.column(1), similarity):
                doc_id = batch.column(0)[row].as_py()
                for i, (value, first, n_words) in best.items():
                    for col, x in zip(out, (doc_id, model.items[i].item_id, value, first, n_words)):
                        col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    held, chars = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for row in items.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        chars += len(row["text"])
        if len(held) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _shared(benchmark: DataFrame, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many items there are; the shingles that several have, ascending, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, at = shingles(*words(*utf8(batch.column(0))), n)
            own = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64) if own else [], pa.int64())], ["s"])

    texts = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = texts.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("df")).where("df > 1").toArrow()
    hashes, df = found["s"].to_numpy().view(np.uint64), found["df"].to_numpy()
    order = np.argsort(hashes)
    return benchmark.count(), hashes[order], df[order]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item's best window in each document."""
    out, shared = None, _shared(benchmark, n)
    for items in _item_blocks(benchmark):
        found = _search(docs, Model(items, n, radius, shared), similarity)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "first_word", "n_words")).alias("best")).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the rows that hold an item; same columns, no shuffle."""
    shared = _shared(benchmark, n)
    for items in _item_blocks(benchmark):
        docs = _filter(docs, Model(items, n, radius, shared), similarity)
    return docs


def _filter(docs: DataFrame, model: Model, similarity: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, _ in _found(shared.value, batch.column(1), similarity)]] = False
            yield batch.filter(pa.array(clean)).select([0])

    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    kept = boxed.mapInArrow(run, boxed.select("row").schema)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
