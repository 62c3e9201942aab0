"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, fingerprints, langid, licenses, line_dedup, ngram_join, packing, pii, quality, toxicity

from ..conftest import SF

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 997} le und" for i in range(40_000))
CLASHING = "row n piece start length ids kind h1 doc pos part ahead base terms mentions x v comp grp node key path score y".split()
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "s", 5),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "s", 5),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (None, "Le renard brun saute par dessus le chien paresseux", "fr", "s", 1),
    (None, None, None, None, None),
    (4, LONG, "de", "s", len(LONG)),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund 😀 a@b.org +1 (234) 567-8901", "de", "s", 1),
    (6, "\n\n \t\n", "en", "s", 1),
    (7, "\x00\x0b odd ﻿", "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"clash-{c}") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (4, 1, 0), (2, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Fuchs springt über den faulen Hund"), (1, "brown fox jumps"), (2, None), (3, ""), (None, "fox")], "item_id long, text string")


def operators(spark, docs, labels, benchmark) -> dict:
    files = docs.drop("path", "key").withColumnsRenamed({"doc_id": "key", "source": "path"})
    return {
        "packing": lambda: packing.pack(docs, TOKENS),
        "lines": lambda: line_dedup.dedup_lines(docs),
        "join": lambda: ngram_join.near_duplicates(docs),
        "prints": lambda: fingerprints.fingerprint_with_edits(docs),
        "plain prints": lambda: fingerprints.fingerprint_documents(docs),
        "licenses": lambda: licenses.inherit(licenses.scan(files)),
        "quality": lambda: quality.score(docs, quality.train(docs, labels)),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels)),
        "pii": lambda: pii.find(docs),
        "sanitise": lambda: pii.sanitise(docs),
        "leaks": lambda: decontam.contaminated(docs, benchmark),
        "language": lambda: langid.identify(docs, langid.train(docs)),
    }


NAMES = ["packing", "lines", "join", "prints", "plain prints", "licenses", "quality", "toxicity", "pii", "sanitise", "leaks", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(name, spark, awkward, labels, benchmark):
    out = operators(spark, awkward, labels, benchmark)[name]().collect()
    if name in ("lines", "prints", "plain prints", "licenses", "quality", "toxicity", "pii", "sanitise", "language"):
        assert len(out) == len(ROWS)
    if name == "packing":
        assert sum(r["length"] for r in out if r["doc_id"] in (2, 3)) == 2
    if name == "join":
        assert len(out) == 8 and {r["component_id"] for r in out if r["doc_id"] == 1} == {1} and {r["n_shingles"] for r in out if r["doc_id"] in (2, 3, 6)} == {0}
    if name == "leaks":
        assert {(r["doc_id"], r["item_id"]) for r in out} == {(5, 1), (1, 1), (1, None)}
    if name in ("quality", "toxicity"):
        assert all(0 <= r["score"] <= 1 for r in out)
    if name == "language":
        assert {r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 6)} == {"und"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, spark, awkward, labels, benchmark):
    assert operators(spark, awkward.limit(0), labels.limit(0), benchmark.limit(0))[name]().collect() == []


def test_no_labels_and_no_items(spark, awkward, labels, benchmark):
    for name in ("quality", "toxicity", "leaks", "language"):
        found = operators(spark, awkward.drop("lang").withColumn("lang", F.lit(None).cast("string")), labels.limit(0), benchmark.limit(0))[name]().collect()
        assert len(found) == (0 if name == "leaks" else len(ROWS))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark, awkward):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (awkward, awkward.limit(0)):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        rows = out.collect()
        assert bool(rows) == (docs is awkward)
        if name == "ngram_join" and rows:
            assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 1, 2, 3, 4, 5, 6, 7]


def test_pipeline_decisions(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    packed = corpus_pipeline.run(spark, SF).collect()
    left = {r["doc_id"] for r in packed}
    assert left <= set(docs)
    assert not any(any(item in docs[d] for item in items) for d in left)
    seen = {}
    for r in packed:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 2048 for parts in seen.values())
