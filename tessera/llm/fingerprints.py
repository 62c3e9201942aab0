"""Document fingerprints by consistent weighted sampling.

A document is a bag of n-word shingles weighted by how often they occur.  Each
of ``samples`` components draws, for every shingle, gamma variates r and c and
a uniform b from a table that the shingle's hash and the component index, and
keeps the shingle whose ln a = ln c - r (t - b) - r is least, where
t = floor(ln w / r + b).  Two documents keep the same (shingle, t) with a
probability equal to their generalised Jaccard similarity, so the share of
equal components estimates it.

Cases: null and empty texts and texts without words have the fingerprint of no
shingles, which is like itself (1) and like no other; fewer than ``n`` words
are one shingle; repeated rows and rows with a null ``doc_id`` (last in order)
are documents of their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffle_width
from .text import blocks, mix, shingles, utf8, words

SAMPLES = 64
_TABLE_BITS = 16
_rng = np.random.default_rng(77)
_R = _rng.gamma(2.0, 1.0, 1 << _TABLE_BITS)
_LN_C = np.log(_rng.gamma(2.0, 1.0, 1 << _TABLE_BITS))
_B = _rng.random(1 << _TABLE_BITS)
_LN_A_ONCE = (_LN_C + _R * _B - _R).astype(np.float32)  # of a shingle that occurs once: t is 0
_PICK = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16-bit digests of the sampled (term, t); ``terms`` in ascending order."""
    if not len(terms):
        return np.zeros(samples, np.uint16)
    best = np.full(samples, np.inf, np.float32)
    term = np.zeros(samples, np.uint64)
    level = np.zeros(samples, np.int64)
    lane = np.arange(samples)
    for first in range(0, len(terms), _CHUNK):
        own, weight = terms[first : first + _CHUNK], weights[first : first + _CHUNK]
        pick = (own[:, None] * _PICK[:samples]) >> np.uint64(64 - _TABLE_BITS)
        value = _LN_A_ONCE[pick]
        t = None
        many = np.flatnonzero(weight > 1)
        if len(many):
            at = pick[many]
            r, b = _R[at], _B[at]
            t = np.floor(np.log(weight[many])[:, None] / r + b)
            value[many] = _LN_C[at] - r * (t - b) - r
        low = value.argmin(0)
        better = value[low, lane] < best
        best = np.where(better, value[low, lane], best)
        term = np.where(better, own[low], term)
        if t is not None:
            row = np.searchsorted(many, low).clip(max=len(many) - 1)
            level = np.where(better, np.where(many[row] == low, t[row, lane], 0), level)
        else:
            level = np.where(better, 0, level)
    return (mix(term * _PICK[samples : 2 * samples] + level.astype(np.int64).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def signatures(column: pa.Array, n: int = 5, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit components for each text."""
    raw, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, samples), np.uint16)
    for a, b in blocks(offsets):
        h, at = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        s, s_at = shingles(h, at, n)
        for d in range(b - a):
            out[a + d] = signature(*np.unique(s[s_at[d] : s_at[d + 1]], return_counts=True), samples)
    return out


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal components of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(f), ">u2") for f in (a, b))
    return float((x == y).mean())


def fingerprint_documents(docs: DataFrame, n: int = 5, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(x) for x in signatures(batch.column(1), n, samples)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FLUSH_CHARS = 2_000_000


def _range_ends(source: DataFrame, width: int) -> tuple[np.ndarray, int | None]:
    """Ids of the table that cut it into some ``width`` ranges of like size, ascending, and the largest id.

    Quantiles are of doubles, which tell ids apart only up to 2^53; so they are taken
    of the distance from the least id, and each gives way to the next id that there is.
    """
    span = source.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    least, most = span["least"], span["most"]
    if least is None or width < 2:
        return np.empty(0, np.int64), most
    distance = (F.col("doc_id").cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")).cast("double")
    steps = F.array(*(F.lit(i / width) for i in range(1, width)))
    cuts = sorted({least + int(x) for x in source.agg(F.percentile_approx(distance, steps, 100 * width).alias("at")).first()["at"]} - {least})
    if not cuts:
        return np.empty(0, np.int64), most
    place = F.size(F.filter(F.array(*(F.lit(x) for x in cuts)), lambda x: x <= F.col("doc_id")))
    found = source.where("doc_id is not null").groupBy(place.alias("place")).agg(F.min("doc_id").alias("first")).collect()  # a row for each range
    return np.array(sorted(r["first"] for r in found if least < r["first"] < most), np.int64), most


def fingerprint_with_edits(docs: DataFrame, n: int = 5, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edit, and their likeness; also to the next text.

    The next document is the one of the next smaller ``doc_id`` (ties by text,
    nulls last), and the first after the last.  Texts move once, to ranges of
    ``doc_id`` whose ends are ids of the table; the document at each end is
    also sent to the range before, which needs it as its last one's next.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width = shuffle_width(spark)
    ends, most = _range_ends(source, width)
    last = len(ends)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            value = ids.fill_null(0).to_numpy()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            part = np.where(null, last, last - np.searchsorted(ends, value))
            at_end = np.flatnonzero(~null & np.isin(value, ends))
            at_top = np.flatnonzero(~null & (value == (most if most is not None else 0)))
            index = np.concatenate((np.arange(len(value)), at_end, at_top))
            parts = np.concatenate((part, part[at_end] - 1, np.full(len(at_top), last)))
            ahead = np.concatenate((np.zeros(len(value), bool), np.ones(len(at_end) + len(at_top), bool)))
            if len(index) > len(value):
                batch = batch.take(pa.array(index))
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(ahead), batch.column(0), batch.column(1)], ["part", "ahead", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text) in order; the last waits for its next
        size, part, first, done = 0, None, "", False

        def flush(following: str | None) -> Iterator[pa.RecordBatch]:
            """Results of all that is held, or of all but the last."""
            nonlocal held, size
            texts = [x for _, x in held] + ([following] if following is not None else [])
            count = len(texts) - 1
            edits = [edit(texts[i], texts[i + 1]) for i in range(count)]
            own, edited = signatures(pa.array(texts, pa.large_string()), n, samples), signatures(pa.array(edits, pa.large_string()), n, samples)
            cols = [
                pa.array([i for i, _ in held[:count]], pa.int64()), pa.array([len(x) for x in texts[:count]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                pa.array([fingerprint(x) for x in own[:count]], pa.string()), pa.array([fingerprint(x) for x in edited], pa.string()),
                pa.array((own[:count] == edited).mean(1)), pa.array((own[:count] == own[1:]).mean(1)),
            ]
            held = held[count:] if following is None else []
            size = sum(len(x) for _, x in held)
            if count:
                yield pa.RecordBatch.from_arrays(cols, RESULT.replace(",", "").split()[::2])

        for batch in batches:
            for p, ahead, doc_id, text in zip(*(batch.column(i) for i in range(4))):
                p, ahead, doc_id, text = p.as_py(), ahead.as_py(), doc_id.as_py(), text.as_py()
                if p != part:
                    if held:
                        yield from flush(first)
                    part, first, done = p, text, False
                if not ahead:
                    held.append((doc_id, text))
                    size += len(text)
                    if size > FLUSH_CHARS and len(held) > 1:
                        yield from flush(None)
                elif not done and held:
                    yield from flush(text)
                    done = True
        if held:
            yield from flush(first)

    dealt = source.mapInArrow(deal, "part int, ahead boolean, doc_id long, text string")
    ordered = dealt.repartitionById(last + 1, "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(run, RESULT)
