"""Pinned behaviour of dataset, archive and configuration operators, with files."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import validate
from tessera.functions import text
from tessera.operators import annotations as a
from tessera.operators import archive, config, detection, presentation
from tessera.sources import yolo, zip_archive


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "set"
    for p in ("images/train", "labels/train"):
        (root / p).mkdir(parents=True)
    for name in ("images/img1.jpg", "images/img2.png", "images/train/img3.jpg", "images/notes.txt"):
        (root / name).write_bytes(b"x")
    (root / "labels/img1.txt").write_text("0 0.5 0.5 0.2 0.2\n1 0.6 0.6 0.2 0.2\n\nbad\n")
    (root / "labels/img3.txt").write_text("1 0.1 0.1 0.1 0.1\n")
    (root / "data.yaml").write_text("names: {1: banana, 0: apple}\n")
    return str(root)


def test_yolo_folder(spark, folder):
    rows = {r["rel_path"]: (r["split"], r["label_rel_path"]) for r in yolo.images(spark, folder).collect()}
    assert rows == {"img1.jpg": ("raw", "img1.txt"), "img2.png": ("raw", None), "train/img3.jpg": ("train", "img3.txt")}
    assert yolo.class_names(folder) == [(0, "apple"), (1, "banana")]
    assert yolo.boxes(spark, folder).count() == 3
    yolo.write_labels(yolo.label_lines(spark, folder), folder + "-out")
    assert open(folder + "-out/labels/img1.txt").read() == "0 0.5 0.5 0.2 0.2\n1 0.6 0.6 0.2 0.2\nbad\n"
    yolo.write_yaml(folder + "-out", {0: "a", 2: "c"})
    assert config.read_file(folder + "-out/data.yaml")["nc"] == 3


def test_class_table():
    assert a.class_table(["apple"]) == [(0, "apple")] and a.class_table("apple") == [(0, "apple")]
    with pytest.raises(ValueError):
        a.class_table(None)


def test_remap_lines(spark):
    lines = spark.createDataFrame([(0, "0 a"), (1, "1  b"), (2, "2 c"), (3, "invalid_line"), (4, "")], "k int, line string")
    assert [r["line"] for r in a.remap_lines(lines, {0: 2, 1: 0}).orderBy("k").collect()] == ["2 a", "0 b", "2 c", "invalid_line", ""]


def test_remap_dictionary():
    assert a.remap_dictionary(["apple"], {"apple": "fresh_apple"}) == ([(0, "fresh_apple")], 1)
    for bad in ({"pear": "x"}, {5: "x"}, {1.5: "x"}):
        with pytest.raises((ValueError, TypeError)):
            a.remap_dictionary(["apple", "banana"], bad)


def test_merge(spark):
    classes = spark.createDataFrame([(0, 0, "apple"), (0, 1, "banana"), (1, 0, "banana"), (1, 1, "orange")], "src int, class_id int, name string")
    assert [(r["name"], r["new_id"]) for r in a.merge_classes(classes).orderBy("new_id").collect()] == [("apple", 0), ("banana", 1), ("orange", 2)]
    boxes = spark.createDataFrame([(1, 0), (1, 1), (1, 9)], "src int, class_id int")
    assert [(r["class_id"], r["new_class"], r["unknown"]) for r in a.merge_boxes(boxes, classes).orderBy("class_id").collect()] == [(0, 1, False), (1, 2, False), (9, 9, True)]


def test_cuts():
    assert a.cuts(361, (0.8, 0.1, 0.1)) == (288, 36, 37) and a.cuts(10, (0.5, 0.5, 0.0)) == (5, 5, 0) and a.cuts(10, (0.8,)) == (8, 1, 1)
    for bad in ((0.5, 0.6), (1.2, -0.3, 0.1), (0.4,), ()):
        with pytest.raises(ValueError):
            validate.partition_ratios(bad)
    with pytest.raises(ValueError):
        validate.split_ratios((0.6, 0.5))
    with pytest.raises(TypeError):
        validate.check_type("1", int, "x")


def test_pixel_boxes(spark):
    box = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)], "xc double, yc double, w double, h double")
    r = a.pixel_boxes(box, 120, 100, 2).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (28, 23, 92, 77)


def test_area_filter(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, "small"), (0.0, 0.0, 90.0, 90.0, "large")], "x1 double, y1 double, x2 double, y2 double, label string")
    assert [r["label"] for r in detection.filter_area(boxes, F.lit(100), F.lit(100), 0.2).collect()] == ["small"]


def test_human_size(spark):
    sizes = [0, 1024, 1536, 1152, 1 << 40]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(text.human_size(F.col("n"))).collect()]
    assert got == ["0.00 B", "1.00 KB", "1.50 KB", "1.12 KB", "1.00 TB"]


def test_human_size_of_any_bigint(spark):
    """Times 100 these are beyond a bigint."""
    sizes = [(1 << 63) - 1, 1_200_000**2 << 21, (5 << 60) // 4, (1 << 62) + (3 << 37), 1023, (1 << 20) - 1, (1 << 40) + (1 << 37)]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(text.human_size(F.col("n"))).collect()]
    assert got == ["8388608.00 TB", "2746582.03 TB", "1310720.00 TB", "4194304.38 TB", "1023.00 B", "1024.00 KB", "1.12 TB"]
    assert got == [f"{n / 1024**k:.2f} {unit}" for n, (k, unit) in zip(sizes, [(4, "TB")] * 4 + [(0, "B"), (1, "KB"), (4, "TB")])]


def test_zip(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "one.txt").write_text("one")
    (source / "two.txt").write_text("two")
    target = str(tmp_path / "a.zip")
    zip_archive.compress(spark, str(source), target)
    with zipfile.ZipFile(target) as z:
        assert z.namelist() == ["source/one.txt", "source/two.txt"]
    with pytest.raises(Exception, match="exists|Exists"):
        zip_archive.compress(spark, str(source), target)
    members = zip_archive.read(spark, target)
    archive.test(members)
    assert [r["name"] for r in archive.search(members, "*/tw?.txt").collect()] == ["source/two.txt"]
    assert archive.info(members).first()["file_count"] == 2
    with pytest.raises(KeyError):
        archive.remove(members, ["nope"])
    left = archive.remove(members, ["source/one.txt"])
    assert zip_archive.write(left.withColumn("archive", F.lit("b.zip")), str(tmp_path)) == ["b.zip"]
    assert zip_archive.extract(zip_archive.read(spark, str(tmp_path / "b.zip")), str(tmp_path / "out")) == 1
    assert (tmp_path / "out/source/two.txt").read_text() == "two"
    (tmp_path / "out/source/one.txt").write_text("own")
    with pytest.raises(Exception, match="exists"):
        zip_archive.extract(members, str(tmp_path / "out"))
    assert (tmp_path / "out/source/one.txt").read_text() == "own"
    (tmp_path / "out/source/two.txt").unlink()
    with pytest.raises(Exception, match="exists"):
        zip_archive.extract(members, str(tmp_path / "out"))
    assert not (tmp_path / "out/source/two.txt").exists()  # nothing is written before all are looked at
    assert zip_archive.extract(members, str(tmp_path / "out"), overwrite=True) == 2
    (source / "deep/er").mkdir(parents=True)
    (source / "deep/er/three.txt").write_text("three")
    zip_archive.compress(spark, str(source), str(tmp_path / "deep.zip"))
    zip_archive.compress(spark, str(source), str(tmp_path / "deep.zip"), overwrite=True)
    zip_archive.compress(spark, str(source / "one.txt"), str(tmp_path / "one.zip"))
    assert [r["name"] for r in zip_archive.read(spark, str(tmp_path / "deep.zip")).orderBy("ord").collect()] == ["source/deep/er/three.txt", "source/one.txt", "source/two.txt"]
    assert [bytes(r["content"]) for r in zip_archive.read(spark, str(tmp_path / "one.zip")).collect()] == [b"one"]
    bad = spark.createDataFrame([("a", "../x", bytearray(b""))], "archive string, name string, content binary")
    with pytest.raises(Exception, match="outside"):
        zip_archive.extract(bad, str(tmp_path / "out"))
    broken = members.withColumn("crc", F.lit(1))
    with pytest.raises(ValueError, match="one.txt"):
        archive.test(broken)


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    config.Config.create_default(path)
    config.write_file(path, {"default": {"root": "/data", "x": "./stay"}, "a": {"images": "./images", "n": 3}, "top": "./top"}, overwrite=True)
    c = config.Config(path)
    assert c.a["images"] == "/data/images" and c.tree["default"]["x"] == "./stay" and c.top == "./top"
    for suffix in ("json", "toml"):
        c.export_file(str(tmp_path / f"c.{suffix}"))
        assert config.read_file(str(tmp_path / f"c.{suffix}"))["a"] == {"images": "./images", "n": 3}
    with pytest.raises(ValueError):
        c.export_file(str(tmp_path / "d.yml".replace("yml", "yaml")))
    with pytest.raises(ValueError):
        config.read_file("x.csv")


def test_metadata(spark):
    good = spark.createDataFrame([('[{"path": "a.jpg", "boxes": [[1, 2, 3, 4]], "scores": [0.9], "labels": ["apple"]}]',)], "value string")
    assert detection.read_metadata(good).first()["labels"] == ["apple"]
    bad = spark.createDataFrame([('[{"path": "a.jpg", "boxes": [], "scores": [0.9], "labels": []}]',)], "value string")
    with pytest.raises(Exception, match="lengths differ"):
        detection.read_metadata(bad).collect()


def test_crop_labels(spark):
    crops = spark.createDataFrame([("apple/a_crop_0.jpg",), ("pear_crop_1.png",), ("x.jpg",), ("y.txt",)], "path string")
    assert {(r["path"], r["label"]) for r in presentation.read_crops(crops).collect()} == {("apple/a_crop_0.jpg", "apple"), ("pear_crop_1.png", "pear")}
    assert presentation.read_crops(crops, label="pear").count() == 1


def test_streaming_registry(spark, tmp_path):
    from tessera.streaming.registry import first_seen

    spark.createDataFrame([("b", 2, 0), (" A", 1, 0), ("a", 0, 1)], "label string, frame_index long, det_index int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("label string, frame_index long, det_index int").parquet(str(tmp_path / "in"))
    q = first_seen(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["label"], r["first"]["frame_index"]) for r in spark.table("seen").collect()} == {("a", 0), ("b", 2)}


def png(width: int, height: int, pixel: tuple[int, int, int]) -> bytes:
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = (b"\0" + bytes(pixel) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_and_crops(spark, tmp_path):
    from tessera.sources import media

    (tmp_path / "nested").mkdir()
    (tmp_path / "red.png").write_bytes(png(12, 8, (255, 0, 0)))
    (tmp_path / "nested/green.png").write_bytes(png(6, 4, (0, 255, 0)))
    (tmp_path / "notes.txt").write_text("x")
    images = media.read_images(spark, str(tmp_path), recursive=True)
    assert [(r["image"]["width"], r["image"]["height"]) for r in images.collect()] == [(6, 4), (12, 8)]
    red = media.read_images(spark, str(tmp_path / "red.png"))
    assert media.to_rgb(red).first()["rgb"][:3] == bytearray((255, 0, 0))
    box = red.select(F.lit(1).cast("long").alias("image_id"), F.lit(0).alias("det_index"), F.lit(2).alias("x1"), F.lit(1).alias("y1"), F.lit(7).alias("x2"), F.lit(4).alias("y2"), "image")
    crop = presentation.crop_pixels(box).first()
    assert (crop["width"], crop["height"]) == (5, 3) and bytes(crop["data"]) == bytes((0, 0, 255)) * 15
    assert not media.is_video(str(tmp_path / "red.png"))


def test_detector_to_label_lines(spark):
    frames = spark.createDataFrame([("v", 0, 64, 48, b"x"), ("v", 1, 64, 48, b"y")], "source string, frame_index long, width int, height int, image binary")
    model = detection.Model(lambda image, prompt, **_: [(5, 5, 20, 20, 0.9, " Apple "), (0, 0, 64, 48, 0.9, "all"), (1, 1, 2, 2, 0.1, "low")])
    found = model.set_input_kwargs(a=1).predict(frames, "fruit", max_area=0.5)
    lines = [r["line"] for r in detection.yolo_lines(found, F.lit(64), F.lit(48)).orderBy("frame_index").collect()]
    assert lines == ["0 0.195312 0.260417 0.234375 0.312500"] * 2
    with pytest.raises(ValueError):
        model.predict(frames, "fruit", max_area=1.5)


def test_drawing_anchor(spark):
    box = spark.createDataFrame([(20.9, 20.0, 80.0, 80.0, "apple", 0.9), (0.0, 40.0, 5.0, 50.0, "b", None)], "x1 double, y1 double, x2 double, y2 double, label string, score double")
    assert [(r["text_x"], r["text_y"], r["caption"]) for r in presentation.draw_anchors(box).collect()] == [(20, 38, "apple 0.90"), (0, 35, "b")]
