"""Best-fit packing of documents into fixed-length token sequences.

Lengths are at most ``capacity``, so a plan over the histogram of lengths says
everything: however many documents there are, the driver holds one count per
length.  The planner indexes sums of one, two and three lengths and consumes
the combinations that exactly fill the gap beside a longer piece, as far as
counts allow; what stays goes by best fit.  The plan is a list of patterns,
each for a run of sequences; executors place a piece from its rank among the
pieces of its length.

Cases: a null or empty text is a document of the terminator alone; repeated
rows and rows with null ids are packed each for itself; an empty table gives
no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import durable
from .text import tidy

#: Rows of one length that one task ranks at most, about.
RANK_ROWS = 10_000
#: Runs without white space beyond this many characters are left to the tokenizer itself.
LONG_RUN = re.compile(r"\S{4096}")


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text under a byte-level BPE file, special strings included.

    The file's merge ranks drive tiktoken's encoder, which gives the same ids
    several times faster than the reference implementation of the file format;
    texts with huge unbroken runs, where its merging is quadratic, go to that one.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    to_byte = {v: k for k, v in _byte_letters().items()}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text):
            return _reference(path).encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special=allowed, disallowed_special=())

    return encode


@functools.lru_cache(maxsize=2)
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE files write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece: all are full but perhaps the first."""
    start, length = 0, (n - 1) % capacity + 1
    while start < n:
        yield start, length
        start, length = start + length, capacity


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces; ``ids`` only if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}

            def flush() -> pa.RecordBatch:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = list(rows) if with_ids else list(rows)[:-1]
                out = pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, kinds) if k in names], names)
                for x in rows.values():
                    x.clear()
                return out

            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.asarray([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    for name, value in zip(rows, (doc_id.as_py(), k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None)):
                        rows[name].append(value)
                held += len(ids)
                if held > 500_000:
                    yield flush()
                    held = 0
            if rows["piece"]:
                yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES + (", ids array<int>" if with_ids else ""))


@dataclass
class Plan:
    """For each run of pieces of one length: where the run's pieces go."""

    capacity: int
    n_sequences: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first rank, first sequence, copies in each, offset
    used: dict[int, int] = field(default_factory=dict)

    def add(self, lengths: list[int], times: int) -> None:
        """``times`` sequences of these lengths, longest first."""
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            k = lengths.count(length)
            self.rows.append((length, self.used.get(length, 0), self.n_sequences, k, offset))
            self.used[length] = self.used.get(length, 0) + k * times
            offset += k * length
        self.n_sequences += times


class _Sums:
    """Pairs and triples of lengths by their sum, as far as counts allow them.

    A sum's entry is made when it is first asked for.  Counts only fall, so what has
    run out is taken from its entry for good; single lengths are indexed by the counts themselves.
    """

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        self.pairs: dict[int, list[int]] = {}  # sum -> smaller lengths, ascending
        self.triples: dict[int, list[int]] = {}  # sum -> lengths that some pair completes, ascending

    def there(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def pairs_of(self, total: int) -> list[int]:
        if total not in self.pairs:
            small = np.arange(1, total // 2 + 1)
            self.pairs[total] = small[(self.left[small] > 0) & (self.left[total - small] > 0)].tolist()
        return self.pairs[total]

    def pair(self, total: int, held: list[int]) -> list[int] | None:
        """The two lengths of this sum with the largest smaller one that are there beside what is held."""
        own = self.pairs_of(total)
        for k in range(len(own) - 1, -1, -1):
            found = [own[k], total - own[k]]
            if not self.there(found):
                del own[k]
            elif self.there([*held, *found]):
                return found
        return None

    def triple(self, total: int, held: list[int]) -> list[int] | None:
        """A largest length and a pair of the rest that are there beside what is held."""
        if total not in self.triples:
            self.triples[total] = [x for x in np.flatnonzero(self.left[: max(total - 1, 0)]).tolist() if self.pairs_of(total - x)]
        own = self.triples[total]
        for k in range(len(own) - 1, -1, -1):
            if not self.left[own[k]] or not self.pairs_of(total - own[k]):
                del own[k]
            elif self.there([*held, own[k]]) and (rest := self.pair(total - own[k], [*held, own[k]])):
                return [own[k], *rest]
        return None


def plan_packing(counts: dict[int, int], capacity: int = 2048) -> Plan:
    """Patterns that use each length exactly as often as it is there."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = Plan(capacity)

    def use(lengths: list[int]) -> None:
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            left[x] -= times
        plan.add(lengths, times)

    sums = _Sums(left)
    if left[capacity]:
        use([capacity])
    for size in (1, 2, 3):  # how many lengths fill the gap
        for longest in range(capacity - 1, 0, -1):
            gap = capacity - longest
            while left[longest]:
                if size == 1:
                    found = [gap] if sums.there([longest, gap]) else None
                elif size == 2:
                    found = sums.pair(gap, [longest])
                else:
                    found = sums.triple(gap, [longest])
                if not found:
                    break
                use([longest, *found])
    _best_fit(left, plan)
    return plan


def _best_fit(left: np.ndarray, plan: Plan) -> None:
    """Longest first, each into the fullest open sequence that it fits."""
    room: dict[int, list[list]] = {}  # free tokens -> [lengths, how many such sequences]
    for length in range(plan.capacity, 0, -1):
        n = int(left[length])
        while n:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                k = min(plan.capacity // length, n)
                times = n // k
                room.setdefault(plan.capacity - k * length, []).append([[length] * k, times])
                n -= times * k
                continue
            lengths, times = room[free].pop()
            if not room[free]:
                del room[free]
            k = min(free // length, n)
            took = min(times, n // k)
            if took < times:
                room.setdefault(free, []).append([lengths, times - took])
            room.setdefault(free - k * length, []).append([[*lengths, *[length] * k], took])
            n -= took * k
    for groups in room.values():
        for lengths, times in groups:
            plan.add(lengths, times)


def place(pieces: DataFrame, capacity: int = 2048) -> tuple[DataFrame, int]:
    """Give every piece of ``pieces(id, length, ...)`` a ``sequence_id`` and an ``offset``; also how many sequences.

    ``id`` is unique.  Ranks within a length come from counts per (length,
    salt): the salt grows with the table, so a length that holds a third of all
    pieces is ranked by many tasks.  Only ids and lengths are ranked; whatever
    else pieces carry joins their places in the end.
    """
    salts = max(1, -(-pieces.count() // RANK_ROWS))
    salted = pieces.select("id", "length", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id"))).join(before, ["length", "salt"])
    ranked = ranked.select("id", "length", (F.col("rank") + F.col("before") - 1).alias("rank"))
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    by_length = np.searchsorted(rows[:, 0], np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                a, b = by_length[x], by_length[x + 1]
                at[own] = a + np.searchsorted(rows[a:b, 1], rank[own], "right") - 1
            _, first, sequence, copies, offset = rows[at].T if len(at) else rows[:0].T
            within = rank - first
            out = [sequence + within // np.maximum(copies, 1), offset + within % np.maximum(copies, 1) * length]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in out)], ["id", "sequence_id", "offset"])

    places = ranked.mapInArrow(run, "id long, sequence_id long, offset long")
    return pieces.join(places, "id").drop("id"), plan.n_sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pack all documents; a row per piece with its place.

    ``with_ids`` also carries the ids; without, only their checksum.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity, end_id, with_ids)
    return place(durable(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces"), capacity)[0]


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids in order of offset (at most ``capacity`` pieces each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"),
        F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("parts", lambda x: x["offset"]).alias("offsets"),
    )
