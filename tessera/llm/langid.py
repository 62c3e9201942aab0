"""Language identification as a mixture: what share of a document is in which language.

Training counts hashed byte trigrams of words for each language, over at most
``PER_LANGUAGE`` documents of each, picked by a hash of their id.  A document is
a mixture of languages whose words each come from one of them;
expectation-maximisation estimates the shares from the words' trigram
likelihoods, until no share of a document moves by ``SETTLED`` any more.  Languages then leave in order of their share as long as that
lowers the penalised likelihood ``-2 ln L + k ln(words)``; what remains is the
document's language set, and the largest share names its language.

Cases: null and empty texts and texts without a letter (``str.isalpha``) are ``und`` with score
0, and so is every text when no labelled document has a letter; ties go to the
language that sorts first; repeated rows are each predicted; rows with a null
``doc_id`` are predicted but not learned from; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import durable, release
from .text import blocks, tidy, utf8

#: Most labelled documents that are learned from, for each language.
PER_LANGUAGE = 1500
#: Sampled ids are broadcast up to this many (some 32 bytes each).
LEAD_BITS, BROADCAST_IDS = 12, 200_000
BUCKET_BITS = 16
#: Added to every trigram count.
SMOOTHING = 0.5
#: Words' log-likelihoods are scaled by this: their trigrams overlap.
TEMPER = 0.5
#: Shares that move less have settled; and most rounds of a document, should they not.
SETTLED, MOST_ROUNDS = 0.01, 50
LETTER = re.compile(r"[^\W\d_]")  # numbers that are no digits, such as fractions, match too
BLOCK = 2 << 20

_KIND = np.full(256, 0x20, np.uint8)  # what is no letter separates words
_KIND[0x61:0x7B] = np.arange(0x61, 0x7B)
_KIND[0x41:0x5B] = np.arange(0x61, 0x7B)
_KIND[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text or ""))


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets in order, where each word's begin, and where each document's words begin.

    A word counts with a blank on either side, so a word of k bytes has k trigrams.
    """
    text = _KIND[raw]
    inside = text != 0x20
    n = len(text)
    if not n or not inside.any():
        return np.empty(0, np.int64), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    at = np.flatnonzero(inside)
    before = np.where(start[at], 0x20, text[np.maximum(at - 1, 0)]).astype(np.uint32)
    after = np.where(end[at], 0x20, text[np.minimum(at + 1, n - 1)]).astype(np.uint32)
    code = (before << np.uint32(16)) | (text[at].astype(np.uint32) << np.uint32(8)) | after
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    first = np.flatnonzero(start[at])
    return bucket.astype(np.int64), np.concatenate((first, [len(at)])), np.searchsorted(at[first], offsets)


def _only(docs: np.ndarray, like: np.ndarray, who: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some documents: likelihoods, numbers of the documents from 0, where each begins, and how many."""
    kept = np.zeros(len(count), bool)
    kept[docs] = True
    many = count[docs]
    return like[:, kept[who]], np.repeat(np.arange(len(docs)), many), np.cumsum(many) - many, many


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket x language

    def shares(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each document's language shares; all 0 for one without words."""
        bucket, word_at, doc_at = grams(raw, offsets)
        n_langs, n_docs = len(self.languages), len(offsets) - 1
        shares = np.zeros((n_docs, n_langs))
        count = np.diff(doc_at)
        if not n_langs or not count.any():
            return shares
        full = np.flatnonzero(count)
        starts = doc_at[:-1][full]
        ll = np.stack([np.add.reduceat(self.log_p[bucket, i], word_at[:-1]) for i in range(n_langs)]) * TEMPER
        top = ll.max(0)
        like = np.maximum(np.exp(ll - top), 1e-300)  # language x word; what remains of a set must explain all words
        pi = np.full((n_langs, len(full)), 1.0 / n_langs)
        alive = np.ones((n_langs, len(full)), bool)

        def improve(pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares that have settled, and the log-likelihood of each document."""
            pi = pi.copy()
            live = np.flatnonzero((pi > 0).sum(0) > 1)  # a single language has nothing to share
            own, owner, first, many = like, who, starts, count[full]
            if len(live) < len(full):
                own, owner, first, many = _only(live, like, who, count[full])
            for _ in range(MOST_ROUNDS):
                if not len(live):
                    break
                part = own * pi[:, live][:, owner]
                part /= part.sum(0)
                new = np.add.reduceat(part, first, axis=1) / many
                moving = np.flatnonzero(np.abs(new - pi[:, live]).max(0) >= SETTLED)
                pi[:, live] = new
                if len(moving) < len(live):
                    own, owner, first, many = _only(moving, own, owner, many)
                    live = live[moving]
            return pi, np.add.reduceat(np.log((like * pi[:, who]).sum(0)), starts)

        who = np.repeat(np.arange(len(full)), count[full])
        pi, fit = improve(pi)
        best, best_cost = pi, -2 * fit + n_langs * np.log(count[full])
        for k in range(n_langs - 1, 0, -1):
            low = np.where(alive, pi, np.inf).argmin(0)
            alive[low, np.arange(len(full))] = False
            pi = np.where(alive, np.maximum(pi, 1e-12), 0)
            pi, fit = improve(pi / pi.sum(0))
            cost = -2 * fit + k * np.log(count[full])
            best, best_cost = np.where(cost < best_cost, pi, best), np.minimum(cost, best_cost)
        shares[full] = best.T
        return shares


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from ``labelled(doc_id, text, lang)``; rows without ``lang`` teach nothing."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    # the first ids in order of a hash, whose leading bits are counted first: only ids around the last of a language are ranked
    keys = rows.select("lang", "doc_id", F.xxhash64("text").alias("row")).distinct().withColumn("h", F.xxhash64("doc_id", "row")).withColumn("lead", F.shiftright("h", 64 - LEAD_BITS))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("lead"))
    room = keys.groupBy("lang", "lead").agg(F.count("*").alias("n")).withColumn("room", F.lit(per_language) - (upto - F.col("n"))).where("room > 0")
    near = keys.join(room, ["lang", "lead"])
    rank = F.row_number().over(Window.partitionBy("lang", "lead").orderBy("h", "doc_id", "row"))
    picks = near.where("n <= room").unionByName(near.where("n > room").withColumn("rank", rank).where("rank <= room").drop("rank"))
    picks = durable(picks.select("lang", "doc_id", "row"), "language-sample")
    small = picks.count() <= BROADCAST_IDS
    picked = rows.withColumn("row", F.xxhash64("text")).join(F.broadcast(picks) if small else picks, ["lang", "doc_id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                raw, offsets = utf8(batch.column(1).filter(pa.array(langs == lang)))
                total = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for a, b in blocks(offsets, BLOCK):
                    total += np.bincount(grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], minlength=1 << BUCKET_BITS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    counted = picked.select("lang", "text").mapInArrow(tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    release(picks)
    languages = sorted(set(counted["lang"].to_pylist()))
    table = np.full((1 << BUCKET_BITS, len(languages)), SMOOTHING)
    where = {lang: i for i, lang in enumerate(languages)}
    table[counted["bucket"].to_numpy(), [where[x] for x in counted["lang"].to_pylist()]] += counted["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages): the set as (language, share), largest first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            shares = np.concatenate([model.shares(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, BLOCK)] or [np.zeros((0, len(model.languages)))])
            langs, scores, sets = [], [], []
            for text, share in zip(batch.column(1), shares):
                text = text.as_py()
                if not share.any() or not has_letter(text):
                    langs.append("und"), scores.append(0.0), sets.append([])
                    continue
                order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
                langs.append(model.languages[order[0]])
                scores.append(min(1.0, float(share[order[0]])))
                sets.append([{"lang": model.languages[i], "share": float(share[i])} for i in order])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang string, share double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; same columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            shares = np.concatenate([model.shares(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, BLOCK)] or [np.zeros((0, len(model.languages)))])
            told = [bool(share.any() and has_letter(text.as_py())) for text, share in zip(batch.column(1), shares)]
            yield batch.filter(pa.array(told, pa.bool_())).select([0])

    boxed = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    kept = boxed.mapInArrow(tidy(run), boxed.select("row").schema)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
