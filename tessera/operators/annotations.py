"""Labelled image datasets as tables of images, boxes and classes.

``images(image_id, dataset, rel_path, split, stem, label_rel_path)``,
``boxes(image_id, line_no, class_id, xc, yc, w, h)`` and
``classes(dataset, class_id, name)``; label texts are lines of
``class xc yc w h``.  Order never comes from rows but from a column.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import validate
from ..functions import text

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
SPLITS = ("train", "val", "test")
#: Keys sampled for each range of a ranking.
PER_RANGE = 20


def scan_images(files: DataFrame) -> DataFrame:
    """Images of ``files(path)``: directly in images/ or images/<split>/, once each."""
    split = F.regexp_extract("path", r"(?:^|/)images/(train|val|test)/[^/]+$", 1)
    inside = F.col("path").rlike(r"(?:^|/)images/(?:(?:train|val|test)/)?[^/]+$")
    found = files.where(inside & text.suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select("path").distinct()
    rel = F.regexp_extract("path", r"(?:^|/)images/(.*)$", 1)
    return found.select("path", rel.alias("rel_path"), F.when(split == "", "raw").otherwise(split).alias("split"), text.stem(F.col("path")).alias("stem"))


def pair_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """The label at the image's own relative path, else the one of its stem, else null.

    ``images(rel_path, stem, ...)`` and ``labels(rel_path)``; ``expected`` is
    where the label belongs even if there is none.
    """
    expected = F.regexp_replace("rel_path", r"\.[^./]*$", ".txt")
    wanted = images.withColumn("expected", expected).withColumn("fallback", F.concat("stem", F.lit(".txt")))
    exact = labels.select(F.col("rel_path").alias("expected"), F.col("rel_path").alias("exact_path")).distinct()
    flat = labels.select(F.col("rel_path").alias("fallback"), F.col("rel_path").alias("flat_path")).distinct()
    joined = wanted.join(exact, "expected", "left").join(flat, "fallback", "left")
    return joined.select(*images.columns, "expected", F.coalesce("exact_path", "flat_path").alias("label_rel_path"))


def class_table(names: Sequence[str] | Mapping[int, str] | str | None) -> list[tuple[int, str]]:
    """A data.yaml ``names`` entry as (id, name): a list, a mapping by id, or one name."""
    if names is None:
        raise ValueError("names is missing")
    if isinstance(names, Mapping):
        return [(i, str(names[k])) for i, k in enumerate(sorted(names))]
    return [(i, str(x)) for i, x in enumerate([names] if isinstance(names, str) else names)]


def parse_labels(lines: DataFrame) -> DataFrame:
    """Boxes of ``lines(..., line)``: five numbers or more; other lines are left out."""
    parts = F.split(F.btrim("line", F.lit(" \t\r\n\x0b\x0c")), r"\s+")
    parsed = lines.withColumn("parts", parts).where(F.size("parts") >= 5)
    numbers = [F.expr(f"try_cast(parts[{k}] AS double)").alias(c) for k, c in enumerate(("xc", "yc", "w", "h"), 1)]
    out = parsed.select(*lines.columns, F.expr("try_cast(parts[0] AS int)").alias("class_id"), *numbers)
    return out.where("class_id IS NOT NULL AND xc IS NOT NULL AND yc IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")


def pixel_boxes(boxes: DataFrame, width: Column | int, height: Column | int, padding: int = 0) -> DataFrame:
    """Adds x1, y1, x2, y2 in pixels: cut toward zero, padded, inside the image; empty boxes go."""
    wide, high = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    xc, yc, w, h = (F.col(c) for c in ("xc", "yc", "w", "h"))
    out = boxes.withColumns({
        "x1": F.greatest(F.lit(0), ((xc - w / 2) * wide).cast("int") - padding),
        "y1": F.greatest(F.lit(0), ((yc - h / 2) * high).cast("int") - padding),
        "x2": F.least(wide, ((xc + w / 2) * wide).cast("int") + padding),
        "y2": F.least(high, ((yc + h / 2) * high).cast("int") + padding),
    })
    return out.where("x2 > x1 AND y2 > y1")


def name_boxes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``label``: the class name, or ``class_<id>`` where there is none."""
    names = classes.select("class_id", F.col("name").alias("label"))
    joined = boxes.join(names, "class_id", "left")
    return joined.withColumn("label", F.coalesce("label", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))


def _words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\r\n\x0b\x0c")), r"\s+")


def first_number(line: Column) -> Column:
    """A label line's class id, null if it begins with no whole number."""
    return F.get(_words(line), F.lit(0)).try_cast("int")


def remap_line(line: Column, mapping: Mapping[int, int]) -> Column:
    """A line with its first word mapped and white space made single.

    Ids that the mapping lacks stay; lines that start with no number stay as they are.
    """
    parts, old = _words(line), first_number(line)
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)) if mapping else F.create_map().cast("map<int,int>")
    new = F.coalesce(F.try_element_at(table, old), old)
    return F.when(old.isNull(), line).otherwise(F.concat_ws(" ", new.cast("string"), F.slice(parts, 2, F.size(parts))))


def remap_lines(lines: DataFrame, mapping: Mapping[int, int]) -> DataFrame:
    """``line`` by ``remap_line``."""
    return lines.withColumn("line", remap_line(F.col("line"), mapping))


# -- partitions -----------------------------------------------------------
def cuts(total: int, ratios: Sequence[float]) -> tuple[int, int, int]:
    """How many of ``total`` go to train, val and test.

    One ratio leaves equal rests, two leave one; without a test share what
    rounding leaves goes to val, otherwise to test.
    """
    shares = list(ratios)
    if len(shares) == 1:
        shares += [(1 - shares[0]) / 2] * 2
    elif len(shares) == 2:
        shares.append(1 - sum(shares))
    train, val, test = (round(x, 4) for x in shares)
    n_train = int(total * train)
    n_val = total - n_train if test == 0.0 else int(total * val)
    return n_train, n_val, total - n_train - n_val


def hash_order(key: Column, seed: int = 42) -> tuple[Column, Column]:
    """A shuffle that needs no driver: by a digest of the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key


def ranked(images: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``pos``, 0-based over the whole order, without bringing all rows to one task.

    Each range's rows are numbered from the count of the ranges before it.  Range ends are
    keys of a sample by hash (some ``PER_RANGE`` distinct keys a range come to the driver), written
    into the plan, so that every evaluation deals rows alike; ranges that Spark draws anew each
    time would not; so are the counts.  Rows of equal keys are in one range.
    """
    spark = images.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [f"__o{k}" for k in range(len(order))]
    keyed = images.withColumns(dict(zip(names, order)))
    every = max(1, keyed.count() // (PER_RANGE * width))
    sample = keyed.select(*names).where(F.pmod(F.xxhash64(*names), F.lit(every)) == 0).distinct().orderBy(*names).collect()
    ends = [sample[k * len(sample) // width] for k in range(1, width)] if len(sample) >= width else sample[1:]
    key = F.struct(*names)
    if ends:
        types = {f.name: f.dataType for f in keyed.schema.fields}
        step = math.isqrt(len(ends)) + 1
        bound = lambda r: F.struct(*(F.lit(r[n]).cast(types[n]).alias(n) for n in names))
        groups = F.array(*(F.array(*(bound(r) for r in ends[k : k + step])) for k in range(0, len(ends), step)))
        below = lambda bounds: F.size(F.filter(bounds, lambda x: x <= key))
        top = below(F.array(*(bound(r) for r in ends[::step])))  # then only the group that the key is in is looked at
        part = F.when(top == 0, 0).otherwise((top - 1) * step + below(F.element_at(groups, F.greatest(top, F.lit(1)))))
    else:
        part = F.lit(0)
    dealt = keyed.withColumn("__part", part)
    counts = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before = [0, *accumulate(counts.get(k, 0) for k in range(len(ends)))]
    local = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*names)) - 1)
    start = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in before)), F.col("__part") + 1)
    out = local.withColumn("pos", (F.col("__rank") + start).cast("bigint"))
    return out.drop("__part", "__rank", *names)


def partition(images: DataFrame, key: str, ratios: Sequence[float], seed: int = 42) -> DataFrame:
    """Adds ``pos`` and ``split`` by a seeded shuffle of ``key``; counts follow the ratios exactly."""
    n_train, n_val, _ = cuts(images.count(), validate.partition_ratios(ratios))
    split = F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_val, "val").otherwise("test")
    return ranked(images.drop("split"), hash_order(F.col(key), seed)).withColumn("split", split)


repartition = partition  # earlier splits are ignored


def shuffled_like_python(images: DataFrame, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Adds ``pos``: places after Python's own shuffle of the rows in ``order``.

    The permutation is made on the driver, 16 bytes for each image, as exact
    parity with that shuffle needs it; ``hash_order`` does without.
    """
    places = list(range(images.count()))
    random.Random(seed).shuffle(places)
    table = images.sparkSession.createDataFrame(pa.table({"pos": pa.array(places, pa.int64()), "new": pa.array(range(len(places)), pa.int64())}))
    return ranked(images, [F.col(c) for c in order]).join(table, "pos").drop("pos").withColumnRenamed("new", "pos")


def partition_like_python(images: DataFrame, order: Sequence[str], ratios: Sequence[float], seed: int = 42) -> DataFrame:
    """As ``partition``, by Python's own shuffle of the rows in ``order``."""
    n_train, n_val, _ = cuts(images.count(), validate.partition_ratios(ratios))
    split = F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_val, "val").otherwise("test")
    return shuffled_like_python(images.drop("split"), order, seed).withColumn("split", split)


def partition_counts(total: int, ratios: Sequence[float]) -> dict[str, int]:
    return dict(zip(SPLITS, cuts(total, validate.partition_ratios(ratios))))


def unpartition(images: DataFrame, order: str, keep: str = "last") -> DataFrame:
    """All images side by side: ``flat_path`` is the file name.

    Where names collide the last by ``order`` stays, or with ``keep="all"``
    every image, ``n_same`` telling how many share the name.
    """
    flat = images.withColumn("flat_path", text.basename(F.col("rel_path")))
    if keep == "all":
        same = flat.groupBy("flat_path").agg(F.count("*").alias("n_same"))
        return flat.join(same, "flat_path")
    row = F.struct(*(F.col(c) for c in images.columns))
    return flat.groupBy("flat_path").agg(F.max_by(row, order).alias("r"), F.count("*").alias("n_same")).select("flat_path", "n_same", "r.*")


def split_by_ratio(images: DataFrame, key: str, ratios: Sequence[float], seed: int = 42) -> DataFrame:
    """Adds ``part``: as many parts as ratios; the last takes what is left."""
    return ranked(images, hash_order(F.col(key), seed)).withColumn("part", _part(images.count(), ratios))


def split_like_python(images: DataFrame, order: Sequence[str], ratios: Sequence[float], seed: int = 42) -> DataFrame:
    """As ``split_by_ratio``, by Python's own shuffle of the rows in ``order``."""
    return shuffled_like_python(images, order, seed).withColumn("part", _part(images.count(), ratios))


def _part(total: int, ratios: Sequence[float]) -> Column:
    ratios = validate.split_ratios(ratios)
    low, part = 0, F.lit(len(ratios) - 1)
    bounds = []
    for r in ratios[:-1]:
        low += int(total * r)
        bounds.append(low)
    for k, bound in reversed(list(enumerate(bounds))):
        part = F.when(F.col("pos") < bound, k).otherwise(part)
    return part


def split_by_groups(boxes: DataFrame, groups: Sequence[Sequence[int]]) -> DataFrame:
    """A row for each box and group that has its class: ``grp`` and ``new_class``, the class's place in it."""
    table = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(c).alias("class"), F.lit(k).alias("new_class")) for g, classes in enumerate(groups) for k, c in enumerate(classes)))
    hits = F.filter(table, lambda x: x["class"] == F.col("class_id"))
    return boxes.select("*", F.inline(hits)).drop("class")


def split_by_class(boxes: DataFrame, n_classes: int) -> DataFrame:
    return split_by_groups(boxes, [[c] for c in range(n_classes)])


def kept_images(images: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that have a box."""
    return images.join(boxes.select(key), key, "left_semi")


# -- dictionaries ---------------------------------------------------------
def merge_classes(classes: DataFrame) -> DataFrame:
    """(name, new_id) from ``classes(src, class_id, name)``: ids by first appearance.

    Dictionaries are small (a row per class and source), so one task ranks them.
    """
    first = classes.groupBy("name").agg(F.min(F.struct("src", "class_id")).alias("first"))
    rank = F.row_number().over(Window.orderBy("first.src", "first.class_id")) - 1
    return first.select("name", rank.cast("int").alias("new_id"))


def merge_boxes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """``boxes(src, class_id, ...)`` with ``new_class``; ids that their source lacks pass through, ``unknown`` marks them."""
    ids = classes.join(merge_classes(classes), "name").select("src", "class_id", "new_id")
    out = boxes.join(ids, ["src", "class_id"], "left")
    return out.withColumn("new_class", F.coalesce("new_id", "class_id")).withColumn("unknown", F.col("new_id").isNull()).drop("new_id")


def merged_name(src: Column, rel_path: Column) -> Column:
    return F.concat(F.lit("src"), src.cast("string"), F.lit("_"), F.replace(rel_path, F.lit("/"), F.lit("_")))


def remap_dictionary(names: Sequence[str], mapping: Mapping) -> tuple[list[tuple[int, str]], int]:
    """(id, name) after a class map, and nc; of ids that meet, the later one names."""
    moves = validate.class_map(mapping, names)
    out: dict[int, str] = {}
    for old, name in enumerate(names):
        to = moves.get(old, old)
        out[old if isinstance(to, str) else to] = to if isinstance(to, str) else name
    return sorted(out.items()), max(out) + 1


def remap_classes(classes: DataFrame, ids: Mapping[int, int], names: Mapping[int, str]) -> DataFrame:
    """``classes(class_id, name)`` after a map: ids move, names change, the later old id names a shared one."""

    def lookup(table: Mapping, kind: str) -> Column:
        made = F.create_map(*(F.lit(x) for pair in table.items() for x in pair)) if table else F.create_map().cast(f"map<int,{kind}>")
        return F.element_at(made, F.col("class_id"))

    moved = classes.select(F.coalesce(lookup(ids, "int"), "class_id").alias("new_id"), F.coalesce(lookup(names, "string"), "name").alias("name"), "class_id")
    return moved.groupBy(F.col("new_id").alias("class_id")).agg(F.max_by("name", moved["class_id"]).alias("name"))


# -- statistics -----------------------------------------------------------
def dataset_info(images: DataFrame) -> DataFrame:
    """Totals and counts for each split of ``images(split, label_rel_path)``; one row."""
    count = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(s)
    return images.agg(F.count("*").alias("total_images"), F.count("label_rel_path").alias("total_labels"), F.count(F.when(F.col("label_rel_path").isNull(), 1)).alias("unlabeled_images"), *(count(s) for s in (*SPLITS, "raw")))


def class_counts(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, name, n_boxes): classes without boxes have 0, boxes of no class do not count."""
    counts = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.join(counts, "class_id", "left").select("class_id", "name", F.coalesce("n", F.lit(0)).alias("n_boxes"))
