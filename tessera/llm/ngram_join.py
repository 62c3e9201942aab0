"""Exact Jaccard self-join over word n-grams with adaptive multi-match prefixes.

Documents are sets of n-word shingles.  Under one global order of shingles, two
sets of Jaccard similarity ``t`` or more share at least ``l`` of their first
``|x| - ceil(t |x|) + l`` shingles, for any ``l``.  A longer prefix costs more
rows but asks for more shared shingles, so fewer pairs come to verification.
Each document picks its ``l`` from the estimated number of candidates that its
prefix meets; a pair is held to the smaller ``l`` of the two.

* Order: rare shingles come first.  Words and shingles are counted over all
  documents; those seen ``SEEN`` times in a block of a few million are worth a
  place in one of two tables of bounded size.  A shingle's frequency is what its
  words' frequencies make likely, or its own count where that is larger; ties go
  by hash.  The order decides cost and never results.
* Copies: documents with the same set are one representative.
* Candidates: a shingle of few documents yields pairs, counted and held to
  ``l``.  Shingles of many documents are passed over, and ``l`` is less by as many
  as both have.  A document with more of those than matches that are asked for
  is crowded: its prefix grows to the whole set, of which a partner may lack
  only few shingles.  The set is dealt into bundles, more than there may be
  differing shingles, and a pair must share all shingles of as many bundles as
  are left over.  Any two documents that may link either share enough shingles of
  few documents, or both are crowded and share a bundle.
* Verification: pairs are joined with their sets and measured exactly; first one
  pair for each document, then the others that are not connected by then.  So a
  group of copies costs rows in proportion to its size.
* Bundles of many documents are pairs of each document with the first.  Where
  that leaves a bundle's documents in different components, the sets of such
  bundles meet in tiles of bounded size, and tiles within one component do not.

Cases: null and empty texts and texts without words have an empty set and link
with nothing; rows that repeat a ``doc_id`` each get the component of their own
set, where sets under one ``doc_id`` count as linked; rows with a null ``doc_id``
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import durable, release, shuffle_width
from .text import blocks, mix, shingle_sets, shingle_starts, shingles, tidy, utf8, words

#: A block of counting, in words, and how often a word or shingle must occur there to count as perhaps frequent.
COUNT_BLOCK, SEEN = 2_000_000, 3
#: Most rows of the tables of frequent words and of frequent shingles (16 bytes each).
TABLE_ROWS = 1 << 18
#: Documents of a shingle or a bundle of which all pairs are looked at.
FEW = 24
#: Bundles of many documents are broadcast up to this many (8 bytes each), joined by shuffle beyond.
BROADCAST_KEYS = 500_000
#: Pairs for each document that are measured without a first round of one pair for each.
PAIRS_AT_ONCE = 2
#: Fewest and most shared shingles that a prefix asks for, and the length of prefix for which it asks one more.
FEWEST_MATCHES, MOST_MATCHES, CHANCE = 4, 24, 24
#: Shingles of all sets in a tile, about.
TILE = 200_000


def needed(n: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """Least overlap of a set of ``n`` with any other of similarity ``t``: ceil(t n)."""
    return -(-n * t.numerator // t.denominator)


def alike(common: np.ndarray, n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether common / (n + m - common) >= t, in whole numbers."""
    return common * t.denominator >= t.numerator * (n + m - common)


def differing(total: np.ndarray | int, t: Fraction) -> np.ndarray | int:
    """Most shingles that are in only one of two sets of similarity ``t``, from the sum of their sizes."""
    return total * (t.denominator - t.numerator) // (t.denominator + t.numerator)


def matches_for(cost: float, base: int) -> int:
    """How many shared shingles to ask for at a prefix of ``base`` shingles.

    ``cost`` is how many documents share them by what is known; besides, longer
    prefixes meet more documents by chance.
    """
    return min(MOST_MATCHES, FEWEST_MATCHES + int(np.log2(1 + cost / 16)) + int(base) // CHANCE)


def least_ask(n: Column, t: Fraction) -> Column:
    """How many shared shingles any set that may link with one of ``n`` asks for at least, and so does that set."""
    smallest = F.ceil(n * t.numerator / t.denominator - 1e-9)
    need = F.ceil(smallest * t.numerator / t.denominator - 1e-9)
    return F.greatest(F.lit(1), F.least(F.lit(MOST_MATCHES), FEWEST_MATCHES + F.floor((smallest - need + 1) / CHANCE), need))


@dataclass
class Counts:
    """Frequent words and shingles: hashes in ascending order, and how often they were seen."""

    words: np.ndarray
    word_log2: np.ndarray
    rarest_log2: float  # of words that are not in the table
    shingles: np.ndarray
    shingle_count: np.ndarray
    all_log2: float  # of the number of words

    def classes(self, hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """For shingles that begin at these words: twice the log2 of their likely count."""
        log2 = np.full(len(hashes) + n, self.rarest_log2)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            log2[: len(hashes)] = np.where(self.words[at] == hashes, self.word_log2[at], self.rarest_log2)
        total = np.zeros(len(first))
        for k in range(n):
            total += log2[first + k]
        return np.clip(2 * total - 2 * (n - 1) * self.all_log2, -100, 100).astype(np.int16)

    def seen(self, own: np.ndarray) -> np.ndarray:
        """In how many documents each shingle was seen, 0 where it is not in the table."""
        if not len(self.shingles) or not len(own):
            return np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        return np.where(self.shingles[at] == own, self.shingle_count[at], 0)


def _count(docs: DataFrame, n: int) -> Counts:
    """Counts over all documents, two bounded tables of the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> pa.RecordBatch:
            cols: list[list[np.ndarray]] = [[], [], []]
            total = 0
            for kind, parts in enumerate(held):
                value, count = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
                total += int(count.sum()) * (kind == 0)
                keep = count >= SEEN
                for col, x in zip(cols, (np.full(int(keep.sum()), kind), value[keep].view(np.int64), count[keep])):
                    col.append(x.astype(np.int64))
                parts.clear()
            for col, x in zip(cols, (2, 0, total)):  # how many words there are
                col.append(np.array([x], np.int64))
            kind, h, count = (np.concatenate(x) for x in cols)
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(h), pa.array(count)], ["kind", "h", "n"])

        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in blocks(offsets):
                h, at = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                s, s_at = shingles(h, at, n)
                held[0].append(h)
                held[1].extend(np.unique(s[s_at[d] : s_at[d + 1]]) for d in range(b - a))
                size += len(h)
                if size >= COUNT_BLOCK:
                    yield flush()
                    size = 0
        yield flush()

    added = docs.select("text").mapInArrow(tidy(run), "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    seen = durable(added.where((F.col("n") > FEW) | (F.col("kind") == 2)), "counts")
    total = max(1, (seen.where("kind = 2").first() or {"n": 1})["n"])
    word, word_count = _largest(seen.where("kind = 0"))
    shingle, count = _largest(seen.where("kind = 1"))
    release(seen)
    log2 = np.log2(np.maximum(word_count, 1))
    return Counts(word, log2, float(log2.min()) - 2 if len(log2) else 0.0, shingle, count, float(np.log2(total)))


def _largest(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the largest counts, as many whole levels as ``TABLE_ROWS`` holds."""
    level = F.floor(4 * F.log2("n")).cast("int")
    room, least = TABLE_ROWS, None
    for row in sorted(seen.groupBy(level.alias("level")).count().collect(), reverse=True):  # some 200 levels at most
        if row["count"] > room:
            break
        room, least = room - row["count"], row["level"]
    top = seen.where(level >= least if least is not None else F.lit(False)).toArrow()
    h, count = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def _ordered_sets(column: pa.Array, n: int, counts: Counts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each document: its distinct shingles in ascending order, how often each was seen, and the global order."""
    raw, offsets = utf8(column)
    for a, b in blocks(offsets):
        h, at = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        s, s_at = shingles(h, at, n)
        likely = counts.classes(h, shingle_starts(at, n)[0], n)
        for d in range(b - a):
            own, index = np.unique(s[s_at[d] : s_at[d + 1]], return_index=True)
            seen = counts.seen(own)
            rank = likely[s_at[d] : s_at[d + 1]][index] if at[d + 1] - at[d] >= n else np.zeros(len(own), np.int16)
            rank = np.maximum(rank, np.where(seen > 0, 2 * np.log2(np.maximum(seen, 1)), -100))
            yield own, seen, np.lexsort((own, rank))


def _prefixes(n: int, t: Fraction, counts: Counts):
    """Per document: its set's size and signature, and its prefix with the match count it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, sizes, signatures, asks, hashes = [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                sig = np.frombuffer(b"".join(signatures), ">i8").reshape(-1, 2).astype(np.int64)
                out = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]), pa.array(asks, pa.int32()), pa.array(hashes, pa.binary())]
                for x in (ids, rows, sizes, signatures, asks, hashes):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, ["doc_id", "row", "n", "s1", "s2", "ask", "prefix"])

            held = 0
            for doc_id, row, (own, count, order) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _ordered_sets(batch.column(2), n, counts)):
                size = len(own)
                base = size - needed(size, t) + 1
                most = min(size, base + MOST_MATCHES - 1)
                if most:
                    own_prefix, own_count = own[order[:most]], count[order[:most]]
                    ask = matches_for(np.maximum(own_count[:base] - 1, 0).sum(), base)
                    ask = max(1, min(ask, most - base + 1))
                    prefix = own_prefix[: base + ask - 1]
                else:
                    ask, prefix = 1, own
                ids.append(doc_id)
                rows.append(row)
                sizes.append(size)
                signatures.append(xxhash.xxh3_128_digest(own.tobytes()))
                asks.append(ask)
                hashes.append(prefix.tobytes())
                held += len(prefix) + 4
                if held > 500_000:
                    yield flush()
                    held = 0
            if ids:
                yield flush()

    return run


def _explode(t: Fraction, frequent: np.ndarray):
    """A row per prefix shingle: the shingle, the document, its size, its ask and the place's match level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            for first in range(0, size, 4096):
                part = batch.slice(first, 4096)
                ids, n, ask = (part.column(c).to_numpy() for c in ("doc_id", "n", "ask"))
                raw, at = _binary(part.column("prefix"))
                h = raw.view(np.uint64) if len(raw) else np.empty(0, np.uint64)
                lens = np.diff(at) // 8
                who = np.repeat(np.arange(len(ids)), lens)
                place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
                base = n - needed(n, t) + 1
                level = np.maximum(place - base[who] + 2, 1)
                hot = np.isin(h, frequent) if len(frequent) else np.zeros(len(h), bool)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[who]), pa.array(n[who].astype(np.int32)), pa.array(ask[who].astype(np.int8)), pa.array(level.astype(np.int8)), pa.array(hot)], ["h", "doc", "n", "ask", "level", "hot"])

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


def size_bins(t: Fraction, most: int) -> np.ndarray:
    """Least sizes of bins such that sets of similarity ``t`` are in one bin or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(int(out[-1] / t) + 1)
    return np.array(out, np.int64)


MOST_SHINGLES = 1 << 40


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows whose equal keys are together: how many rows each row's key has, and its rows from here on."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lens = np.diff(np.concatenate((edges, [len(key)])))
    return np.repeat(lens, lens), np.repeat(edges + lens, lens) - np.arange(len(key))


def _shared(t: Fraction, need_of):
    """Rows sorted by their key -> (a, b, need) for pairs of a key of few documents.

    Rows are key, doc, n and two numbers that ``need_of(left, right)`` turns into the number of
    keys that a pair must share, 0 for none.  A document of a key of many is a row (doc, n, 0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cols: tuple[np.ndarray, ...], many: int | None) -> Iterator[pa.RecordBatch]:
            key, doc, n = cols[:3]
            size, after = _runs(key)
            large = (size > FEW) | (key == many if many is not None else False)
            out = [(doc[large], n[large], np.zeros(int(large.sum()), np.int64))]
            few = np.flatnonzero(~large & (size > 1))
            for gap in range(1, int(after[few].max()) if len(few) else 0):
                left = few[after[few] > gap]
                right = left + gap
                small, big = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
                ok = (small >= needed(big, t)) & (doc[left] != doc[right]) & (differing(small + big, t) > 0)
                left, right = left[ok], right[ok]
                need = need_of(tuple(x[left] for x in cols[2:]), tuple(x[right] for x in cols[2:]))
                ok = need > 0
                a, b = doc[left[ok]], doc[right[ok]]
                out.append((np.minimum(a, b), np.maximum(a, b), need[ok]))
            a, b, need = (np.concatenate([x[i] for x in out]) for i in range(3))
            for first in range(0, len(a), 100_000):
                part = slice(first, first + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(need[part].astype(np.int32))], ["a", "b", "need"])

        rest, many = None, None
        for batch in batches:
            cols = tuple(batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            if rest is not None:
                cols = tuple(np.concatenate(x) for x in zip(rest, cols))
            if not len(cols[0]):
                continue
            final = cols[0][-1]  # the last key may go on
            last = int(np.searchsorted(cols[0], final))
            if len(cols[0]) - last > FEW or final == many:
                last = len(cols[0])
            yield from pairs(tuple(x[:last] for x in cols), many)
            many = final if last == len(cols[0]) else None
            rest = tuple(x[last:] for x in cols)
        if rest is not None:
            yield from pairs(rest, many)

    return run


def _prefix_need(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of (n, ask, level): the smaller ask, if the shingle is in both prefixes of that ask."""
    need = np.minimum(left[1], right[1])
    return np.where(np.maximum(left[2], right[2]) <= need, need, 0)


@dataclass
class Bundles:
    """How sets are dealt into bundles: one way for the sizes of each bin and the bin below."""

    t: Fraction
    bins: np.ndarray

    def differing(self, total: np.ndarray | int) -> np.ndarray | int:
        return differing(total, self.t)

    def spare(self, b: np.ndarray | int) -> np.ndarray | int:
        """Bundles beyond those that must exist."""
        return 2 + self.differing(2 * (self.bins[b + 1] - 1)) // 8

    def count(self, b: np.ndarray | int) -> np.ndarray | int:
        return self.differing(2 * (self.bins[b + 1] - 1)) + 1 + self.spare(b)

    def own(self, n: np.ndarray | int) -> np.ndarray | int:
        return np.searchsorted(self.bins, n, "right") - 1

    def keys(self, own: np.ndarray, b: int) -> tuple[np.ndarray, int]:
        """A key for each bundle of a set, and how many of its bundles are empty.

        Empty bundles say little and have keys only in sets that have more of them than there are spare ones.
        """
        k = int(self.count(b))
        part = (mix(own + np.uint64(b)) % np.uint64(k)).astype(np.int64)
        content = np.zeros(k, np.uint64)
        np.add.at(content, part, mix(own ^ _SALT))
        filled = np.bincount(part, minlength=k) > 0
        empty = int(k - filled.sum())
        key = mix(content + mix(np.arange(k, dtype=np.uint64) + np.uint64(b << 32)))
        return (key if empty > self.spare(b) else key[filled]), empty

    def need(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of (n, empty, bin): bundles with a key that two sets must share; 0 unless the bin is the larger set's."""
        b, total = left[2], left[0] + right[0]
        must = np.maximum(1, self.count(b) - self.differing(total) - np.minimum(left[1], right[1]))
        return np.where(b == self.own(np.maximum(left[0], right[0])), must, 0)


_SALT = np.uint64(0x5851F42D4C957F2D)


def _bundle_rows(plan: Bundles):
    """(doc, own) -> a row for each bundle: key, document, size of the set, its empty bundles, bin, and whether that is the size's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, cols = 0, ([], [], [], [], [], [])

            def flush() -> pa.RecordBatch:
                key, doc, n, empty, b, home = (np.concatenate(x) for x in cols)
                for x in cols:
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(n.astype(np.int32)), pa.array(empty.astype(np.int32)), pa.array(b.astype(np.int16)), pa.array(home > 0)], ["h", "doc", "n", "empty", "bin", "home"])

            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = own.values.to_numpy().view(np.uint64)
                first = int(plan.own(len(own)))
                for b in (first, first + 1):
                    if not plan.differing(len(own) + int(plan.bins[b + 1]) - 1):
                        continue
                    key, empty = plan.keys(own, b)
                    for col, x in zip(cols, (key, *(np.full(len(key), x, np.int64) for x in (doc, len(own), empty, b, b == first)))):
                        col.append(x)
                    held += len(key)
                if held > 200_000:
                    yield flush()
                    held = 0
            if held:
                yield flush()

    return run


def _local_labels(sets: list[np.ndarray], left: np.ndarray, t: Fraction, label: np.ndarray | None = None, links: list[np.ndarray] | None = None) -> np.ndarray:
    """For each set the first one that links between the sets reach.

    With ``links`` every pair is measured, and arrays of places of linked pairs are appended to it.

    ``left`` marks the first of two tiles; when both marks occur only links
    across count, since each tile is joined with itself elsewhere.  ``label`` has the
    first set of each component that is known before.
    """
    count = len(sets)
    size = np.array([len(x) for x in sets])
    across = bool(left.any() and not left.all())
    _, token, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.concatenate(([0], np.cumsum(size)))
    # tokens of each set, the block's rare ones first
    who = np.repeat(np.arange(count), size)
    order = np.lexsort((token, freq[token], who))
    token = token[order]
    single = freq[token] == 1
    base = size - needed(size, t) + 1
    place = np.arange(len(token)) - np.repeat(at[:-1], size)
    indexed = (place < np.repeat(np.minimum(base + MOST_MATCHES - 1, size), size)) & ~single
    p_token, p_doc = token[indexed], who[indexed]
    by = np.argsort(p_token, kind="stable")
    p_doc = p_doc[by]
    p_at = np.searchsorted(p_token[by], np.arange(len(freq) + 1))
    label = np.arange(count) if label is None else label.copy()
    present = np.zeros(len(freq), bool)
    rank = np.empty(count, np.int64)
    rank[np.argsort(size, kind="stable")] = np.arange(count)
    for x in np.argsort(size, kind="stable"):
        own = token[at[x] : at[x + 1]]
        head = own[: base[x]]
        cost = (p_at[head + 1] - p_at[head]).sum()
        ask = int(min(matches_for(cost, base[x]), needed(int(size[x]), t)))
        probe = own[: base[x] + ask - 1]
        post = [p_doc[p_at[k] : p_at[k + 1]] for k in probe[freq[probe] > 1]]
        if not post:
            continue
        shared = np.bincount(np.concatenate(post), minlength=count)
        met = np.flatnonzero(shared >= ask)
        met = met[(rank[met] < rank[x]) & (size[met] >= needed(int(size[x]), t))]
        if links is None:
            met = met[label[met] != label[x]]
        if across:
            met = met[left[met] != left[x]]
        met = met[np.argsort(shared[met], kind="stable")]  # the likeliest at the end
        present[own] = True
        step = 4
        while len(met):
            now, met = met[-step:], met[:-step]
            step = min(4 * step, 1024)
            common = np.array([np.count_nonzero(present[token[at[y] : at[y + 1]]]) for y in now])
            close = now[alike(common, size[now], size[x], t)]
            if links is not None:
                links.append(np.stack((np.full(len(close), x), close)))
                continue
            for y in close:
                a, b = label[x], label[y]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
            met = met[label[met] != label[x]]
        present[own] = False
    return label


def _join_tile(t: Fraction):
    def run(table: pa.Table) -> pa.Table:
        ids, comp = table["doc"].to_numpy(), table["comp"].to_numpy()
        sets = [x.values.to_numpy().view(np.uint64) for x in table["own"].combine_chunks()]
        _, first, which = np.unique(comp, return_index=True, return_inverse=True)
        known = first[which]
        label = _local_labels(sets, table["left"].to_numpy(), t, known)
        moved = np.flatnonzero(label != known)
        return pa.table({"a": pa.array(ids[label[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    return run


def _link_tile(t: Fraction):
    def run(table: pa.Table) -> pa.Table:
        ids, links = table["doc"].to_numpy(), [np.empty((2, 0), np.int64)]
        _local_labels([x.values.to_numpy().view(np.uint64) for x in table["own"].combine_chunks()], table["left"].to_numpy(), t, links=links)
        pair = ids[np.concatenate(links, 1)]
        return pa.table({"a": pa.array(pair.min(0), pa.int64()), "b": pa.array(pair.max(0), pa.int64())})

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            first, own, held = 0, [], 0
            for i, x in enumerate(shingle_sets(batch.column(batch.schema.get_field_index("text")), n)):
                own.append(x.view(np.int64))
                held += len(x)
                if held > 2 << 20 or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    sets = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32), np.concatenate(own))
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), sets], [*names, "own"])
                    first, own, held = i + 1, [], 0

    return run


@dataclass
class Candidates:
    """What may link: ``each(doc_id, row, n, s1, s2, ...)`` document, ``reps(doc_id, row, s1, s2, ...)``, the ``sets(doc, own)``
    of those with candidates, ``pairs(a, b)`` to measure and members ``large(h, doc, hub)`` of bundles of many, if there are any.
    """

    each: DataFrame
    reps: DataFrame
    sets: DataFrame
    pairs: DataFrame
    large: DataFrame | None
    others: list[DataFrame]

    def release(self) -> None:
        release(self.each, self.reps, self.sets, self.pairs, *self.others)


def _candidates(docs: DataFrame, n: int, t: Fraction) -> Candidates:
    width = shuffle_width(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    counts = _count(source, n)
    each = durable(source.mapInArrow(tidy(_prefixes(n, t, counts)), "doc_id long, row long, n long, s1 long, s2 long, ask int, prefix binary"), "prefixes")
    # one representative of each set
    reps = durable(each.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "row", "n", "ask", "prefix")).alias("r")).select("s1", "s2", "r.*"), "representatives")
    rows = reps.mapInArrow(tidy(_explode(t, counts.shingles)), "h long, doc long, n int, ask byte, level byte, hot boolean")
    shared = "a long, b long, need int"
    cold = rows.where("not hot").select("h", "doc", "n", "ask", "level")
    ties = durable(cold.repartition(width, "h").sortWithinPartitions("h", "doc").mapInArrow(_shared(t, _prefix_need), shared), "ties")
    many = rows.where("hot").select("doc", F.col("n").cast("long")).unionAll(ties.where("need = 0").select(F.col("a").alias("doc"), F.col("b").alias("n")))
    many = many.groupBy("doc", "n").agg(F.count("*").alias("many")).withColumn("crowded", F.col("many") >= least_ask(F.col("n"), t))
    many = durable(many.groupBy("doc").agg(F.max("many").alias("many"), F.max("crowded").alias("crowded")), "crowded")
    paired = _enough(ties, many)
    # the sets of all documents that may have a partner
    wanted = many.where("crowded").select("doc", "crowded").unionByName(paired.select(F.explode(F.array("a", "b")).alias("doc"), F.lit(False).alias("crowded")))
    wanted = durable(wanted.groupBy("doc").agg(F.max("crowded").alias("crowded")), "wanted")
    member = reps.select(F.col("doc_id").alias("doc"), "row").join(wanted, "doc")
    text = source.select(F.col("doc_id").alias("doc"), "row", "text")
    sets = durable(text.join(member.hint("merge"), ["doc", "row"]).dropDuplicates(["doc", "row"]).select("doc", "crowded", "text").mapInArrow(tidy(_sets(n)), "doc long, crowded boolean, own array<long>"), "sets")
    plan = Bundles(t, size_bins(t, MOST_SHINGLES))
    bundles = durable(sets.where("crowded").select("doc", "own").mapInArrow(tidy(_bundle_rows(plan)), "h long, doc long, n int, empty int, bin short, home boolean"), "bundles")
    # a pair counts in its larger set's bin only, so bundles of many sets all of which are at home below that bin are of no use
    many_in = durable(bundles.groupBy("h").agg(F.count("*").alias("docs"), F.min("doc").alias("hub"), F.max("home").alias("home")).where(F.col("docs") > FEW).select("h", "hub", "home"), "bundles-of-many")
    large = many_in.where("home").drop("home")
    n_large, n_many = large.count(), many_in.count()
    keys = F.broadcast(large) if n_many <= BROADCAST_KEYS else large
    in_large = bundles.join(keys, "h").select("h", "doc", "hub") if n_large else None
    few = bundles.drop("home").join(F.broadcast(many_in.select("h")) if n_many <= BROADCAST_KEYS else many_in.select("h"), "h", "left_anti") if n_many else bundles.drop("home")
    found = paired.unionAll(_enough(few.repartition(width, "h").sortWithinPartitions("h", "doc").mapInArrow(_shared(t, plan.need), shared)))
    if n_large:
        found = found.unionAll(in_large.where("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")))
    pairs = durable(found.distinct(), "pairs")
    return Candidates(each, reps, sets, pairs, in_large, [ties, many, wanted, bundles, many_in])


def near_duplicates(docs: DataFrame, n: int = 5, similarity: Fraction | str = "4/5") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` with a ``doc_id``.

    ``component_id`` is the smallest ``doc_id`` that links of at least
    ``similarity`` reach, the row's own included.
    """
    t = Fraction(similarity)
    found = _candidates(docs, n, t)
    each, reps, sets, pairs = found.each, found.reps, found.sets, found.pairs
    if pairs.count() <= PAIRS_AT_ONCE * sets.count():
        links = [durable(_verified(pairs, sets, t), "links")]
        comp = _components(links)
    else:  # one pair of each document first, then those that are not connected by it
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = [durable(_verified(first, sets, t), "links")]
        comp = _components(links)
        links.append(durable(_verified(_apart(pairs.join(first, ["a", "b"], "left_anti"), comp), sets, t), "links"))
        if not links[-1].isEmpty():
            release(comp)
            comp = _components(links)
    if found.large is not None:  # bundles of many documents that are still in several components
        label = found.large.select("h", "doc").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        parted = label.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("h")
        met = durable(label.join(parted, "h").select("h", "doc", "comp"), "parted")
        if not met.isEmpty():
            links.append(durable(_tiles(met, sets, _join_tile(t)), "links"))
            release(comp)
            comp = _components(links)
        release(met)
    whole = reps.select("s1", "s2", F.col("doc_id").alias("node")).join(comp, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("component_id"))
    out = each.select("doc_id", "n", "s1", "s2").join(whole, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    result = durable(out, "near-duplicates")
    found.release()
    release(*links, comp)
    return result


def linked_sets(docs: DataFrame, n: int = 5, similarity: Fraction | str = "4/5") -> tuple[DataFrame, DataFrame]:
    """All links between different texts, as (links, members).

    ``links(a, b)`` has each pair of representatives of at least ``similarity`` once, a < b, and
    ``members(doc_id, representative)`` the smallest ``doc_id`` with the same set for each row with a
    ``doc_id`` and words.  Copies are not expanded into pairs.  Every candidate pair is measured, so groups of
    near copies cost the square of their number of different texts, as their links do; ``near_duplicates``
    does not.  Sets under one ``doc_id`` are taken together: a link of either is one of the ``doc_id``.
    """
    t = Fraction(similarity)
    found = _candidates(docs, n, t)
    links = _verified(found.pairs, found.sets, t)
    if found.large is not None:
        links = links.unionAll(_tiles(found.large.select("h", "doc", F.col("doc").alias("comp")).distinct(), found.sets, _link_tile(t)))
    links = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    members = found.each.select("doc_id", "s1", "s2").join(found.reps.select("s1", "s2", F.col("doc_id").alias("representative")), ["s1", "s2"])
    members = durable(members.select("doc_id", "representative").distinct(), "members")
    found.release()
    return links, members


def link_counts(docs: DataFrame, n: int = 5, similarity: Fraction | str = "4/5") -> DataFrame:
    """(doc_id, class_id, n_links) for every ``doc_id``: its representative and how many other documents it links with, copies included.

    A document without words is its own class and has no link; a ``doc_id`` with several texts has the
    smallest of their classes and the largest of their numbers.
    """
    links, members = linked_sets(docs, n, similarity)
    copies = members.groupBy("representative").agg(F.count("*").alias("copies"))
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = ends.join(copies.withColumnRenamed("representative", "b"), "b").groupBy(F.col("a").alias("representative")).agg(F.sum("copies").alias("others"))
    per_class = copies.join(across, "representative", "left").select("representative", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    per_doc = members.join(per_class, "representative").groupBy("doc_id").agg(F.min("representative").alias("class_id"), F.max("n_links").alias("n_links"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = every.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    result = durable(out, "link-counts")
    release(links, members)
    return result


def _components(links: list[DataFrame]) -> DataFrame:
    return components(_star_members(reduce(DataFrame.unionAll, links)))


def _enough(ties: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """Pairs that share as much as they must, or less by what both may share of ``many(doc, many, crowded)``.

    Two crowded documents meet in bundles.
    """
    counted = ties.where("need > 0").groupBy("a", "b").agg(F.count("*").alias("got"), F.max("need").alias("need"))
    if many is None:
        return counted.where("got >= need").select("a", "b")
    for side in ("a", "b"):
        counted = counted.join(many.select(F.col("doc").alias(side), F.col("many").alias(f"many_{side}"), F.col("crowded").alias(f"crowded_{side}")), side, "left")
    less = F.when(F.coalesce("crowded_a", F.lit(False)) & F.coalesce("crowded_b", F.lit(False)), 0).otherwise(F.least(F.coalesce("many_a", F.lit(0)), F.coalesce("many_b", F.lit(0))))
    return counted.where(F.col("got") >= F.col("need") - less).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs whose sets are similar enough."""
    own = sets.select("doc", "own")
    right = pairs.join(own.select(F.col("doc").alias("b"), F.col("own").alias("right")), "b")
    both = right.join(own.select(F.col("doc").alias("a"), F.col("own").alias("left")), "a")
    common = F.size(F.array_intersect("left", "right")).cast("long")
    return both.where(common * (t.denominator + t.numerator) >= (F.size("left") + F.size("right")).cast("long") * t.numerator).select("a", "b")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of documents in different components."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
    return out.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def _tiles(met: DataFrame, sets: DataFrame, join) -> DataFrame:
    """Links between the components of documents that share groups: ``met`` is (h, doc, comp).

    Groups that share documents make a block.  A component of much text has tiles of
    its own, which are not joined with one another; the others of a block share tiles.
    """
    block_of = components(met.select(F.concat(F.lit("h"), "h").alias("grp"), F.col("doc").alias("node"))).select(F.col("node").alias("doc"), F.col("comp").alias("block"))
    member = block_of.join(met.select("doc", "comp").distinct(), "doc").join(sets.select("doc", F.size("own").alias("n")), "doc")
    size = member.groupBy("block", "comp").agg(F.sum("n").alias("size")).withColumn("alone", F.when(F.col("size") > TILE, F.col("comp")).otherwise(-1))
    cut = size.groupBy("block", "alone").agg(F.ceil(F.sum("size") / F.lit(TILE)).cast("int").alias("tiles"))
    tile = F.struct("alone", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int").alias("part")).alias("tile")
    tiled = durable(member.join(size.select("block", "comp", "alone"), ["block", "comp"]).join(cut, ["block", "alone"]).select("block", "doc", "comp", tile), "tiles")
    every = tiled.select("block", "tile").distinct()
    meet = every.alias("x").join(every.alias("y"), "block").where("x.tile <= y.tile and (x.tile.alone = -1 or x.tile.alone != y.tile.alone)").select("block", F.col("x.tile").alias("t1"), F.col("y.tile").alias("t2"))
    sides = [tiled.withColumnRenamed("tile", "t1").join(meet, ["block", "t1"]).withColumn("left", F.lit(True)), tiled.withColumnRenamed("tile", "t2").join(meet.where("t1 != t2"), ["block", "t2"]).withColumn("left", F.lit(False))]
    rows = sides[0].unionByName(sides[1]).join(sets.select("doc", "own"), "doc").select("block", "t1", "t2", "left", "doc", "comp", "own")
    return rows.groupBy("block", "t1", "t2").applyInArrow(join, "a long, b long")


def _star_members(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as memberships of the group that ``a`` names."""
    return pairs.select(F.concat(F.lit("d"), "a").alias("grp"), F.explode(F.array("a", "b")).alias("node"))


def keep_one(docs: DataFrame, n: int = 5, similarity: Fraction | str = "4/5") -> DataFrame:
    """``docs`` without all but the smallest ``doc_id`` of each group; same columns.

    Rows with a null ``doc_id`` stay; so do all rows of a kept ``doc_id``.
    """
    found = near_duplicates(docs.select("doc_id", "text"), n, similarity)
    gone = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("first")).where("not first").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
