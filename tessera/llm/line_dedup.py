"""Corpus-wide line deduplication.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z lower-cased.  Keys of at least ``min_chars`` code points that occur in two
or more documents keep only the lines of the smallest ``doc_id`` that has them.

Key hashes are range-partitioned with document and position as further sort
columns, so even a key that a third of all lines share is dealt over many
tasks.  Each task streams its sorted lines, remembers the first document of the
key at hand, and reports lines of later documents.  Only the first key of a
task can have begun in an earlier one; such lines are held back and settled
from a summary of one row per task.  What returns to a document is a
compressed bitmap of the lines it keeps, never text.

Cases: a null or empty text is one empty line; a null ``doc_id`` is no
document, so its lines all stay and drop no others; rows that repeat a
``doc_id`` are one document, each losing the same keys; an empty table gives an
empty result; other columns are carried through whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import durable, shuffle_width

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    """Whether the key has ``min_chars`` code points; bytes decide where they can."""
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or sum((b & 0xC0) != 0x80 for b in key) >= min_chars


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs, rows, places = [], [], [], []

            def flush() -> pa.RecordBatch:
                pair = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
                out = pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc", "row", "pos"])
                for x in (hashes, docs, rows, places):
                    x.clear()
                return out

            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for i, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        rows.append(row)
                        places.append(i)
                if len(docs) > 200_000:
                    yield flush()
            if docs:
                yield flush()

    return run


EVENTS = "kind int, h1 long, h2 long, doc long, row long, places binary"
DROP, PENDING, LAST = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of key, document and position -> what to drop.

    DROP: settled here.  PENDING: lines of the task's first key in its first
    document here.  LAST: the task's last key and its first document here.
    """
    key: tuple[int, int] | None = None
    first_key, first_doc = None, None
    for batch in batches:
        h1, h2, doc, row, pos = (batch.column(i).to_numpy() for i in range(5))
        if not len(h1):
            continue
        new = np.empty(len(h1), bool)
        new[0] = key != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run_of = np.cumsum(new) - 1 + (not new[0])
        starts = np.flatnonzero(new)
        firsts = np.concatenate(([first_doc] if not new[0] else [], doc[starts])).astype(np.int64)
        first_of = firsts[run_of]
        if first_key is None:
            first_key = (h1[0], h2[0])
        out = {DROP: doc != first_of, PENDING: (h1 == first_key[0]) & (h2 == first_key[1]) & (doc == first_of)}
        for kind, mask in out.items():
            at = np.flatnonzero(mask)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(x[at]) for x in (h1, h2, doc, row)), pa.array([p.tobytes() for p in pos[at].astype("<i4")], pa.binary())], ["kind", "h1", "h2", "doc", "row", "places"])
        key, first_doc = (h1[-1], h2[-1]), int(first_of[-1])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([LAST], pa.int32()), pa.array([int(key[0])]), pa.array([int(key[1])]), pa.array([first_doc], pa.int64()), pa.array([0], pa.int64()), pa.array([b""], pa.binary())], ["kind", "h1", "h2", "doc", "row", "places"])


def dropped_places(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, row, places): the lines to drop, as little-endian 32-bit positions.

    ``row`` is a hash of the text, which tells rows of one ``doc_id`` apart.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text").where("doc is not null")
    lines = source.mapInArrow(_lines(min_chars), "h1 long, h2 long, doc long, row long, pos int")
    width = shuffle_width(docs.sparkSession)
    events = durable(lines.repartitionByRange(width, "h1", "h2", "doc", "row", "pos").sortWithinPartitions("h1", "h2", "doc", "row", "pos").mapInArrow(_stream, EVENTS), "line-events")
    before = events.where(F.col("kind") == LAST).groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
    settled = events.where(F.col("kind") == PENDING).join(before, ["h1", "h2"]).where("doc > first_doc")
    drops = events.where(F.col("kind") == DROP).select("doc", "row", "places").unionAll(settled.select("doc", "row", "places"))
    return drops


def keep_bitmap(places: np.ndarray) -> bytes:
    """A deflated bitmap with a 1 for each line that stays, whole bytes up to the last 0."""
    keep = np.ones(int(places.max()) // 8 * 8 + 8, bool)
    keep[places] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def _to_bitmap(places: "pa.Array") -> "pa.Array":
    out = []
    for parts in places.to_pylist():
        out.append(keep_bitmap(np.frombuffer(b"".join(parts), "<i4")))
    return pa.array(out, pa.binary())


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, row, bitmap) of every document that loses a line.

    Lines beyond the end of a bitmap stay.
    """
    to_bitmap = F.arrow_udf(_to_bitmap, T.BinaryType())
    grouped = dropped_places(docs, min_chars).groupBy("doc", "row").agg(F.collect_list("places").alias("places"))
    return grouped.select("doc", "row", to_bitmap("places").alias("bitmap"))


def kept_mask(bitmap: bytes | None, n_lines: int) -> np.ndarray | None:
    if bitmap is None:
        return None
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)
    return np.concatenate([bits, np.ones(n_lines - len(bits), bool)])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        at = names.index("__text")
        texts, lines, dropped = [], [], []
        for text, bitmap in zip(batch.column(at), batch.column(names.index("__bitmap"))):
            text, bitmap = text.as_py(), bitmap.as_py()
            n = (text or "").count("\n") + 1
            keep = kept_mask(bitmap, n)
            lines.append(n)
            dropped.append(0 if keep is None else int(n - keep.sum()))
            texts.append(text if keep is None else "\n".join(x for x, k in zip(text.split("\n"), keep) if k))
        cols = [batch.column(names.index("__row")), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["__row", "__text", "__n_lines", "__n_dropped"])


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All columns of ``docs`` under ``row``, with ``text``, ``n_lines`` and ``n_dropped``.

    ``text`` is what stays, joined by newlines (null stays null); ``n_lines``
    counts lines before dropping.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    left = docs.select(row.alias("__row"), F.col("text").alias("__text"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__hash"))
    bitmaps = keep_bitmaps(docs, min_chars).select(F.col("doc").alias("__doc"), F.col("row").alias("__hash"), F.col("bitmap").alias("__bitmap"))
    joined = left.join(bitmaps, ["__doc", "__hash"], "left").select("__row", "__text", "__bitmap")
    schema = T.StructType([joined.schema["__row"], T.StructField("__text", T.StringType()), T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
    out = joined.mapInArrow(_apply, schema)
    return out.select(F.col("__row").alias("row"), F.col("__text").alias("text"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


def dedup_documents(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the same columns, ``text`` without its dropped lines."""
    return dedup_lines(docs, min_chars).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
