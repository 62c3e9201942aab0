"""Values, limits and plans of the library's operators."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import annotations, archive, config, detection, presentation, tensor
from tessera.sources import media


def png(rows: list[list[tuple[int, int, int]]]) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = b"".join(b"\0" + bytes(x for pixel in row for x in pixel) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_decimals_equal_pythons(spark):
    rng = random.Random(1)
    values = [0.5, 1.5, 2.5, -0.5, 0.125, 0.375, 1e-9, -1e-9, -0.0, 0.0, 0.0000005, 0.0000015, 123456789.0000005, 1e14 + 0.5, 2.675, 1.005]
    values += [rng.uniform(-2, 2) for _ in range(2000)] + [k / 2**21 for k in range(500)] + [rng.uniform(0, 1e9) for _ in range(300)] + [float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", *(text.fixed(F.col("x"), d).alias(f"d{d}") for d in (0, 2, 6))).collect()
    for r in rows:
        assert [r["d0"], r["d2"], r["d6"]] == [f"{r['x']:.0f}", f"{r['x']:.2f}", f"{r['x']:.6f}"]


def test_video_suffixes(tmp_path):
    for suffix, yes in ((".m4v", True), (".webm", True), (".MP4", True), (".wmv", False), (".flv", False)):
        (tmp_path / f"a{suffix}").write_bytes(b"")
        assert media.is_video(str(tmp_path / f"a{suffix}")) == yes
    assert not media.is_video(str(tmp_path / "none.mp4"))


def test_images_that_cannot_be_read_raise(spark, tmp_path):
    (tmp_path / "B.png").write_bytes(png([[(255, 0, 0), (0, 0, 255)]]))
    (tmp_path / "a.png").write_bytes(png([[(1, 2, 3)]]))
    (tmp_path / "notes.txt").write_text("no image")
    found = media.read_images(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["a.png", "B.png"] and bytes(found[1]["image"]["data"]) == bytes([0, 0, 255, 255, 0, 0])
    (tmp_path / "c.jpg").write_bytes(b"not a picture")
    with pytest.raises(Exception, match="could not read image"):
        media.read_images(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        media.read_images(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        media.read_images(spark, str(tmp_path / "empty"))


def test_parts_close_when_they_have_members(spark):
    sizes = [0, 0, 50, 3, 0, 9, 11, 0, 4]
    rows = spark.createDataFrame([("a", k, n) for k, n in enumerate(sizes)], "archive string, ord bigint, compress_size bigint")
    parts, want, part, used, count = archive.split_by_size(rows, 10).orderBy("ord").collect(), [], 1, 0, 0
    for n in sizes:
        if count and used + n > 10:
            part, used, count = part + 1, 0, 0
        used, count = used + n, count + 1
        want.append(part)
    assert [r["part"] for r in parts] == want == [1, 1, 2, 3, 3, 4, 5, 6, 6]


def test_default_is_left_alone_at_any_depth(spark):
    tree = {"default": {"root": "/r", "x": "./a"}, "top": "./b", "m": {"default": {"p": "./c"}, "q": "./d", "n": {"default": "./e", "z": "./f"}}}
    assert config.expand(tree) == {"default": {"root": "/r", "x": "./a"}, "top": "./b", "m": {"default": {"p": "./c"}, "q": "/r/d", "n": {"default": "./e", "z": "/r/f"}}}
    flat = config.table(spark, tree)
    assert {tuple(r["path"]): r["v"] for r in flat.select("path", config.expand_value(F.col("path"), F.col("value"), F.lit("/r")).alias("v")).collect()} == {tuple(p): v for p, v in config.flatten(config.expand(tree))}


def test_an_empty_grid_raises(spark):
    with pytest.raises(ValueError):
        presentation.grid_layout(spark.createDataFrame([], "pos bigint, width int, height int"), 3)


def test_products_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(tensor, "BLOCK", 4)
    rng = np.random.default_rng(3)
    a, b = rng.random((9, 11)), rng.random((11, 6))
    made = tensor.tensor(spark, a.tolist(), dtype="float64").matmul(tensor.tensor(spark, b.tolist(), dtype="float64"))
    assert made.shape == (9, 6) and np.allclose(made.tolist(), a @ b)


def test_products_copy_no_block(spark, monkeypatch):
    """64 blocks meet 64; what is shuffled are the cells and their blocks, once."""
    monkeypatch.setattr(tensor, "BLOCK", 8)
    x = tensor.from_rows(spark.range(512).select("id", F.array(*(F.sin(F.col("id") * 8.0 + k) for k in range(8))).alias("v")), "id", "v", (512, 8), "float64")
    product = x.matmul(x.t()).base
    rows, todo = 0, [product._jdf.queryExecution().executedPlan()]
    assert len(product.collect()) == 512 * 512
    while todo:
        plan = todo.pop()
        kids = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        if plan.nodeName() == "Exchange":
            rows += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        todo += kids + [children.apply(k) for k in range(children.size())]
    assert 0 < rows <= 2 * (512 * 8 + 64)


def test_blocks_are_as_wide_as_their_columns(spark, monkeypatch):
    """512 rows of 8 columns move as cells and as blocks of 256 x 8, and tasks get some CELLS of the product."""
    monkeypatch.setattr(tensor, "CELLS", 1 << 14)
    x = tensor.from_rows(spark.range(512).select("id", F.array(*(F.sin(F.col("id") * 8.0 + k) for k in range(8))).alias("v")), "id", "v", (512, 8), "float64")
    product = x.matmul(x.t()).base
    moved, todo = 0, [product._jdf.queryExecution().executedPlan()]
    assert len(product.collect()) == 512 * 512
    while todo:
        plan = todo.pop()
        kids = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        if plan.nodeName() == "Exchange":
            moved += plan.metrics().apply("dataSize").value()
        children = plan.children()
        todo += kids + [children.apply(k) for k in range(children.size())]
    assert 0 < moved < 1_000_000
    assert product.rdd.getNumPartitions() == 5 * 5


def test_ranks_are_whole_whatever_is_asked_for(spark):
    """More rows than a range partitioning samples, with columns that some branches of the plan do without."""
    rows = spark.range(0, 60_000, 1, 3).select((F.col("id") * 7919 % 60_000).alias("k"), F.md5(F.col("id").cast("string")).alias("x"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 5).alias("g"))
    placed = annotations.ranked(rows, [F.col("k")])
    assert placed.where("pos <> k").isEmpty() and placed.select("pos", "x").distinct().count() == 60_000
    tied = annotations.ranked(rows, [F.col("g"), F.col("k")])
    assert tied.agg(F.countDistinct("pos"), F.max("pos")).first()[:] == (60_000, 59_999)
    assert tied.groupBy("g").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).where("b - a + 1 <> n").isEmpty()
    frames = media.frames(rows.withColumn("s", F.lit("one")), "s", "k")
    assert frames.where("frame_index <> k").isEmpty()


def test_frames_and_merges_over_many_ranges(spark):
    """With 200 ranges, as many as Spark's own default, of columns that are read from a file."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_id", "ts", "event_type")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("source").alias("archive"), F.col("doc_id").alias("ord"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for source in ("stream", "event_type"):
            found = media.frames(events.withColumn("stream", F.lit("stream")), source, "ts").select("event_id", "source", "frame_index").toPandas()
            rows = events.withColumn("stream", F.lit("stream")).select("event_id", source, "ts").toPandas().sort_values([source, "ts"])
            want = dict(zip(rows["event_id"], zip(rows[source], rows.groupby(source).cumcount())))
            assert len(found) == len(want) == 100_000 and all(want[e] == (s, k) for e, s, k in found.itertuples(index=False)), source
        tied = events.withColumns({"stream": F.lit("stream"), "ts": F.lit(0)})
        assert media.frames(tied, "stream", "ts", "event_id").agg(F.count("*"), F.min(F.col("event_id") - F.col("frame_index")), F.max(F.col("event_id") - F.col("frame_index"))).first()[:] == (100_000, 0, 0)
        order = [(r["from_archive"], r["ord"]) for r in archive.merge(docs, "all.zip").select("from_archive", "ord").collect()]
        assert sorted(k for _, k in order) == list(range(10_000)) and [a for a, _ in sorted(order, key=lambda x: x[1])] == sorted(a for a, _ in order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_window_takes_all_rows(spark, capsys):
    members = spark.createDataFrame([(f"a{i % 3}", i, f"n{i}") for i in range(30)], "archive string, ord bigint, name string")
    events = spark.createDataFrame([("s", i) for i in range(20)], "stream string, ts bigint")
    boxes = spark.createDataFrame([(i, 0, f"L{i % 4}") for i in range(20)], "frame_index int, det_index int, label string")
    merged, numbered, classes = archive.merge(members, "all.zip"), media.frames(events, "stream", "ts"), detection.class_registry(boxes)
    assert [r["ord"] for r in merged.orderBy("from_archive", "ord").collect()] == list(range(30))
    assert [r["frame_index"] for r in numbered.orderBy("ts").collect()] == list(range(20))
    assert {r["label"]: r["class_id"] for r in classes.collect()} == {f"l{k}": k for k in range(4)}
    v = tensor.from_columns(spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 4.0)], "k int, v double"), ["k"], v="float64")["v"]
    assert v.tolist() == [2.0, 4.0, 1.0]
