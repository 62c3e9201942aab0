"""Archives, detections and crops as files."""

from __future__ import annotations

import json
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from tessera.sources import archives, detections


def make(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return str(path)


def held(path) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(path) as z:
        return [(m.filename, z.open(m).read()) for m in z.infolist()]


def test_facts_of_an_archive(spark, tmp_path):
    path = make(tmp_path / "a.zip", one="x" * 1000, d__two="y")
    info = archives.get_info(spark, path)
    assert (info["format"], info["file_count"], info["uncompressed_size"], info["archive_size"]) == ("zip", 2, 1001, (tmp_path / "a.zip").stat().st_size)
    assert info["compress_ratio"] == round((1 - info["compressed_size"] / 1001) * 100, 2) and archives.test(spark, path)
    assert [r["name"] for r in archives.list_files(spark, path).collect()] == ["one", "d/two"] == [r["name"] for r in archives.search(spark, path, "*").orderBy("ord").collect()]
    assert archives.extract_file(spark, path, "d/two", str(tmp_path / "x")) == 1 and (tmp_path / "x" / "two").read_text() == "y"
    assert archives.extract(spark, path, str(tmp_path / "y")) == 2
    (tmp_path / "b.txt").write_text("no")
    for call, error in ((lambda: archives.get_info(spark, str(tmp_path / "no.zip")), FileNotFoundError), (lambda: archives.get_info(spark, str(tmp_path)), ValueError), (lambda: archives.get_info(spark, str(tmp_path / "b.txt")), ValueError), (lambda: archives.search(spark, path, 3), TypeError), (lambda: archives.extract(spark, path, str(tmp_path / "b.txt")), ValueError), (lambda: archives.extract_file(spark, path, "zzz", str(tmp_path / "x")), KeyError)):
        with pytest.raises(error):
            call()


def test_add_remove_merge_split(spark, tmp_path):
    path = make(tmp_path / "a.zip", one="1", two="22", three="333")
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "f.txt").write_text("f")
    (tmp_path / "in" / "e.txt").write_text("e")
    (tmp_path / "one").write_text("new one")
    archives.add(spark, path, [str(tmp_path / "in"), str(tmp_path / "one")])
    assert held(path) == [("one", b"1"), ("two", b"22"), ("three", b"333"), ("in/deep/f.txt", b"f"), ("in/e.txt", b"e"), ("one_dup", b"new one")]
    archives.remove(spark, path, ["two", "in/e.txt"])
    assert [n for n, _ in held(path)] == ["one", "three", "in/deep/f.txt", "one_dup"]
    other = make(tmp_path / "0.zip", one="again")
    archives.merge(spark, [path, other], str(tmp_path / "m.zip"))
    assert held(tmp_path / "m.zip") == [*held(path), ("one", b"again")]
    parts = archives.split(spark, str(tmp_path / "m.zip"), str(tmp_path / "parts"), 8)
    assert parts == sorted(p.name for p in (tmp_path / "parts").iterdir()) and len(parts) > 1 and parts[0] == "m_part_001.zip"
    assert [x for p in sorted((tmp_path / "parts").iterdir()) for x in held(p)] == held(tmp_path / "m.zip")
    for call, error in ((lambda: archives.remove(spark, path, "gone"), KeyError), (lambda: archives.add(spark, path, str(tmp_path / "gone")), FileNotFoundError), (lambda: archives.add(spark, path, 5), TypeError), (lambda: archives.merge(spark, [path], str(tmp_path / "z.zip")), ValueError), (lambda: archives.merge(spark, [path, other], str(tmp_path / "m.zip")), FileExistsError), (lambda: archives.merge(spark, [path, other], str(tmp_path / "m.tar")), ValueError), (lambda: archives.split(spark, path, str(tmp_path / "parts"), 0), ValueError), (lambda: archives.split(spark, str(tmp_path / "m.zip"), str(tmp_path / "parts"), 8), FileExistsError)):
        with pytest.raises(error):
            call()


FOUND = "source string, frame_index bigint, det_index int, x1 double, y1 double, x2 double, y2 double, score double, label string"


def test_detections_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([("v", k, 100, 50, bytes([k])) for k in range(3)], "source string, frame_index bigint, width int, height int, content binary")
    found = spark.createDataFrame([("v", 0, 0, 0.0, 0.0, 50.0, 25.0, 0.5, " Cat"), ("v", 2, 0, 10.0, 10.0, 20.0, 20.0, 0.9, "dog"), ("v", 2, 1, 0.0, 0.0, 100.0, 50.0, 0.75, "cat")], FOUND)
    detections.write_dataset(found, frames, str(tmp_path / "set"))
    assert yaml.safe_load((tmp_path / "set" / "data.yaml").read_text()) == {"path": str(tmp_path / "set"), "train": "images", "nc": 2, "names": ["cat", "dog"]}
    assert [(tmp_path / "set" / "labels" / f"frame_{k}.txt").read_text() for k in range(3)] == ["0 0.250000 0.250000 0.500000 0.500000", "", "1 0.150000 0.300000 0.100000 0.200000\n0 0.500000 0.500000 1.000000 1.000000"]
    assert (tmp_path / "set" / "images" / "frame_2.jpg").read_bytes() == b"\x02"
    detections.write_annotated(found, frames, str(tmp_path / "seen"))
    back = detections.read_detections(spark, str(tmp_path / "seen")).orderBy("pos").collect()
    assert [(r["path"], r["boxes"], r["scores"], r["labels"]) for r in back] == [("frame_0.jpg", [[0.0, 0.0, 50.0, 25.0]], [0.5], [" Cat"]), ("frame_1.jpg", [], [], []), ("frame_2.jpg", [[10.0, 10.0, 20.0, 20.0], [0.0, 0.0, 100.0, 50.0]], [0.9, 0.75], ["dog", "cat"])]
    with pytest.raises(FileExistsError):
        detections.write_annotated(found, frames, str(tmp_path / "seen"))
    detections.write_annotated(found, frames.limit(0), str(tmp_path / "seen"), overwrite=True)
    with pytest.raises(FileNotFoundError):
        detections.read_detections(spark, str(tmp_path / "nowhere"))
    for item, error in (({"path": "../x.jpg"}, ValueError), ({"path": "gone.jpg"}, FileNotFoundError), ({"path": "a.jpg", "boxes": [[0, 0, 1, 1]]}, ValueError), (3, ValueError), ({}, ValueError)):
        path = make(tmp_path / "d.zip", in__a_jpg="x", **{"in__metadata.json": json.dumps([item])})
        with pytest.raises(error):
            detections.read_detections(spark, path)


def test_crops_round_trip(spark, tmp_path):
    crops = spark.createDataFrame([(0, 0, "big cat!", 0.5, b"a"), (0, 1, "big cat!", 0.25, b"b"), (1, 0, "dog", 1.0, b"c")], "image_id bigint, det_index int, label string, score double, content binary")
    detections.write_crops(crops, str(tmp_path / "crops"))
    assert json.loads((tmp_path / "crops" / "metadata.json").read_text()) == [{"path": "big_cat/frame_0_crop_0.jpg", "score": 0.5, "label": "big cat!"}, {"path": "big_cat/frame_0_crop_1.jpg", "score": 0.25, "label": "big cat!"}, {"path": "dog/frame_1_crop_0.jpg", "score": 1.0, "label": "dog"}]
    back = {r["path"]: (r["label"], r["score"]) for r in detections.read_crops(spark, str(tmp_path / "crops")).collect()}
    assert back == {"big_cat/frame_0_crop_0.jpg": ("big cat!", 0.5), "big_cat/frame_0_crop_1.jpg": ("big cat!", 0.25), "dog/frame_1_crop_0.jpg": ("dog", 1.0)}
    assert detections.read_crops(spark, str(tmp_path / "crops"), "dog").select(F.count("*")).first()[0] == 1
    path = make(tmp_path / "c.zip", **{"cat__x.jpg": "1", "dog_crop_0.png": "2", "plain.jpg": "3"})
    assert {r["path"]: r["label"] for r in detections.read_crops(spark, path).collect()} == {"cat/x.jpg": "cat", "dog_crop_0.png": "dog"}
