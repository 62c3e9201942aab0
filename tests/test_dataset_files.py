"""Datasets from source to target: folders and archives, as files."""

from __future__ import annotations

import random
import zipfile

import pytest
import yaml

from tessera.sources import datasets, files


def make(folder, names, images: dict, top: str = ""):
    """``images``: relative path -> label text or None."""
    root = folder / top if top else folder
    for rel, label in images.items():
        path = root / "images" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"image of " + rel.encode())
        if label is not None:
            at = (root / "labels" / rel).with_suffix(".txt")
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(label)
    (root / "data.yaml").write_text(yaml.safe_dump({"names": names, "nc": len(names), "extra": "kept"}))
    return str(folder)


def zipped(folder, target):
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(x for x in folder.rglob("*") if x.is_file()):
            z.write(p, p.relative_to(folder))
    return str(target)


def tree(path) -> dict[str, bytes]:
    if str(path).endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            assert z.namelist() == sorted(z.namelist())
            return {n: z.read(n) for n in z.namelist()}
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file()}


@pytest.fixture
def fruit(tmp_path):
    images = {f"f{i:02d}.jpg": f"{i % 2} 0.5 0.5 0.2 0.2\n" if i % 7 else None for i in range(40)}
    return make(tmp_path / "fruit", ["apple", "pear"], images), images


@pytest.mark.parametrize("ratios,counts", [((0.8,), (32, 4, 4)), ((0.5, 0.25), (20, 10, 10)), ((0.75, 0.25, 0.0), (30, 10, 0))])
def test_partition_splits_as_python_shuffles(spark, fruit, tmp_path, ratios, counts):
    source, images = fruit
    target = tmp_path / "out"
    datasets.partition(spark, source, str(target), ratios)
    order = sorted(images)
    random.Random(42).shuffle(order)
    ends = (counts[0], counts[0] + counts[1], 40)
    want = {}
    for k, name in enumerate(order):
        split = "train" if k < ends[0] else "val" if k < ends[1] else "test"
        want[f"images/{split}/{name}"] = b"image of " + name.encode()
        if images[name] is not None:
            want[f"labels/{split}/{name[:-4]}.txt"] = images[name].encode()
    got = tree(target)
    settings = yaml.safe_load(got.pop("data.yaml"))
    assert got == want
    assert settings == {"names": ["apple", "pear"], "nc": 2, "extra": "kept", "path": str(target), "train": "images/train", "val": "images/val"} | ({"test": "images/test"} if counts[2] else {})
    with pytest.raises(FileExistsError):
        datasets.partition(spark, source, str(target), ratios)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_repartition_in_place_and_unpartition(spark, fruit, tmp_path):
    source, images = fruit
    datasets.partition(spark, source, source, (0.5, 0.25), overwrite=True)
    datasets.repartition(spark, source, source, (0.9,), overwrite=True, like_python=False)
    parts = [p.split("/")[1] for p in tree(tmp_path / "fruit") if p.startswith("images")]
    assert {s: parts.count(s) for s in set(parts)} == {"train": 36, "val": 2, "test": 2}
    for target in (tmp_path / "flat", tmp_path / "flat.zip"):
        datasets.unpartition(spark, source, str(target))
        got = tree(target)
        settings = yaml.safe_load(got.pop("data.yaml"))
        assert got == {f"images/{n}": b"image of " + n.encode() for n in images} | {f"labels/{n[:-4]}.txt": x.encode() for n, x in images.items() if x is not None}
        assert settings == {"path": str(tmp_path / "flat") if target.suffix != ".zip" else str(tmp_path), "train": "images", "val": "", "test": "", "nc": 2, "names": ["apple", "pear"]}


def test_merge_unites_class_names(spark, tmp_path):
    a = make(tmp_path / "a", ["apple", "banana"], {"img1.jpg": "0 0.5 0.5 0.2 0.2\n1 0.6 0.6 0.2 0.2"})
    make(tmp_path / "b", ["banana", "orange"], {"train/img2.jpg": "0 0.1 0.1 0.1 0.1\n\nnote  x\n7  0.2 0.2 0.2 0.2\n", "img3.png": None}, top="inner")
    target = tmp_path / "m" / "all.zip"
    datasets.merge(spark, [a, zipped(tmp_path / "b", tmp_path / "b.zip")], str(target))
    got = tree(target)
    assert yaml.safe_load(got.pop("data.yaml")) == {"path": "/content/data", "train": "images/train", "val": "images/val", "nc": 3, "names": ["apple", "banana", "orange"]}
    assert got == {
        "images/src0_img1.jpg": b"image of img1.jpg", "labels/src0_img1.txt": b"0 0.5 0.5 0.2 0.2\n1 0.6 0.6 0.2 0.2", "images/src1_img3.png": b"image of img3.png",
        "images/src1_train_img2.jpg": b"image of train/img2.jpg", "labels/src1_train_img2.txt": b"1 0.1 0.1 0.1 0.1\n\nnote  x\n7 0.2 0.2 0.2 0.2\n",
    }
    with pytest.raises(FileExistsError):
        datasets.merge(spark, [a, a], str(target))
    with pytest.raises(ValueError):
        datasets.merge(spark, [a], str(tmp_path / "x.zip"))


def test_split_by_class_group_and_ratio(spark, tmp_path):
    images = {"a.jpg": "0 1 1 1 1\n1 2 2 2 2\n", "b.jpg": "1 3 3 3 3", "c.jpg": None, "d.jpg": "5 1 1 1 1\n2 4 4 4 4\n"}
    source, out = make(tmp_path / "s", ["x", "y", "z", "never"], images), tmp_path / "out"
    assert datasets.split(spark, source, str(out), by_class=True) == ["split_x.zip", "split_y.zip", "split_z.zip"]
    got = tree(out / "split_y.zip")
    assert yaml.safe_load(got.pop("data.yaml")) == {"path": "/content/data", "train": "images/train", "val": "images/val", "nc": 1, "names": ["y"]}
    assert got == {"images/a.jpg": b"image of a.jpg", "labels/a.txt": b"0 2 2 2 2\n", "images/b.jpg": b"image of b.jpg", "labels/b.txt": b"0 3 3 3 3\n"}
    assert datasets.split(spark, source, str(out), class_groups=[["z", "x"], ["y"]], overwrite=True) == ["split_group_0.zip", "split_y.zip"]
    assert tree(out / "split_group_0.zip")["labels/a.txt"] == b"1 1 1 1 1\n" and tree(out / "split_group_0.zip")["labels/d.txt"] == b"0 4 4 4 4\n"
    with pytest.raises(FileExistsError):
        datasets.split(spark, source, str(out), by_class=True)
    assert datasets.split(spark, source, str(out), ratios=(0.5, 0.5)) == ["split_part_0.zip", "split_part_1.zip"]
    order = sorted(images)
    random.Random(42).shuffle(order)
    assert {n for n in tree(out / "split_part_0.zip") if n.startswith("images/")} == {f"images/{n}" for n in order[:2]}
    for wrong in ({}, {"ratios": (0.6, 0.5)}, {"class_groups": []}):
        with pytest.raises(ValueError):
            datasets.split(spark, source, str(out), **wrong)


def test_remap_to_list_and_to_sparse_names(spark, tmp_path):
    source = make(tmp_path / "s", ["apple"], {"train/a.jpg": "0 0.5 0.5 0.1 0.1\n"})
    datasets.remap_classes(spark, source, str(tmp_path / "r.zip"), {"apple": "fresh"})
    got = tree(tmp_path / "r.zip")
    assert yaml.safe_load(got["data.yaml"]) == {"names": ["fresh"], "nc": 1, "extra": "kept", "path": "/content/data"} and got["labels/train/a.txt"] == b"0 0.5 0.5 0.1 0.1\n"
    datasets.remap_classes(spark, source, str(tmp_path / "r"), {0: 1, "apple": "red"})
    got = tree(tmp_path / "r")
    assert yaml.safe_load(got["data.yaml"]) == {"names": {1: "red"}, "nc": 2, "extra": "kept", "path": str(tmp_path / "r")} and got["labels/train/a.txt"] == b"1 0.5 0.5 0.1 0.1\n"
    for wrong, kind in (({"pear": "x"}, ValueError), ({4: 1}, ValueError), ({0: 1.5}, TypeError), ({}, ValueError)):
        with pytest.raises(kind):
            datasets.remap_classes(spark, source, str(tmp_path / "w"), wrong)


def test_info_of_folder_and_archive(spark, fruit, tmp_path):
    source, _ = fruit
    want = {"classes": ["apple", "pear"], "nc": 2, "total_images": 40, "total_labels": 34, "unlabeled_images": 6, "splits": {"raw": 40}}
    assert datasets.dataset_info(spark, source) == want == datasets.dataset_info(spark, zipped(tmp_path / "fruit", tmp_path / "fruit.zip"))
    with pytest.raises(FileNotFoundError):
        datasets.dataset_info(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "data.yaml").write_text("names: [a]")
    with pytest.raises(FileNotFoundError):
        datasets.dataset_info(spark, str(tmp_path / "empty"))


def test_a_failed_write_leaves_no_file(tmp_path):
    with pytest.raises(RuntimeError), files.replacing(f"file://{tmp_path}/a/b.txt") as out:
        out.write(b"half")
        raise RuntimeError
    assert [p.name for p in tmp_path.rglob("*")] == ["a"]
