"""Labelled-dataset operators over boxes, images and dictionaries derived from the fixture tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import annotations as a
from ..session import table
from .registry import query

WIDTH, HEIGHT = 640, 480
BOX = """WITH BOX AS (
  SELECT l_orderkey AS image_id, l_linenumber AS line_no, l_partkey, l_suppkey, l_linenumber - 1 AS class_id,
         (l_partkey % 100 + 0.5::DOUBLE) / 100 AS xc, (l_suppkey % 100 + 0.5::DOUBLE) / 100 AS yc,
         l_quantity / 100 AS w, (l_tax * 100 + 2) / 20 AS h, l_discount * 10 AS score FROM lineitem)
"""
PIXELS = BOX.rstrip() + """, P AS (
  SELECT *, greatest(0, CAST(trunc((xc - w / 2) * 640) AS INT) - 4) AS x1, greatest(0, CAST(trunc((yc - h / 2) * 480) AS INT) - 4) AS y1,
         least(640, CAST(trunc((xc + w / 2) * 640) AS INT) + 4) AS x2, least(480, CAST(trunc((yc + h / 2) * 480) AS INT) + 4) AS y2 FROM BOX),
PIX AS (SELECT * FROM P WHERE x2 > x1 AND y2 > y1)
"""
CLASSES = [(i, f"class-{i}") for i in range(10)]


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box for each line item; images are orders."""
    n = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line_no"), "l_partkey", "l_suppkey", (F.col("l_linenumber") - 1).alias("class_id"),
        ((n % 100 + 0.5) / 100).alias("xc"), ((F.col("l_suppkey") % 100 + 0.5) / 100).alias("yc"),
        (F.col("l_quantity") / 100).alias("w"), ((F.col("l_tax") * 100 + 2) / 20).alias("h"), (F.col("l_discount") * 10).alias("score"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return a.pixel_boxes(boxes(spark, sf), WIDTH, HEIGHT, 4)


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id int, name string")


def images(spark: SparkSession, sf: str) -> DataFrame:
    """An image for each document; labelled ones have a label."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    ids = F.col("doc_id")
    split = F.element_at(F.array(*(F.lit(s) for s in ("train", "val", "test", "raw"))), (ids % 4 + 1).cast("int"))
    found = docs.select(ids.alias("image_id"), F.concat("source", F.lit("/"), (ids % 300).cast("string"), F.lit(".jpg")).alias("rel_path"), split.alias("split"), (ids % 300).cast("string").alias("stem"))
    return found.join(labels.select(F.col("doc_id").alias("image_id"), F.lit(True).alias("has")), "image_id", "left").select("image_id", "rel_path", "split", "stem", F.when(F.col("has"), F.regexp_replace("rel_path", "jpg$", "txt")).alias("label_rel_path"))


IMAGES = """WITH IMG AS (
  SELECT d.doc_id AS image_id, source || '/' || (d.doc_id % 300) || '.jpg' AS rel_path, ['train', 'val', 'test', 'raw'][d.doc_id % 4 + 1] AS split,
         CAST(d.doc_id % 300 AS VARCHAR) AS stem, CASE WHEN l.doc_id IS NOT NULL THEN source || '/' || (d.doc_id % 300) || '.txt' END AS label_rel_path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


@query("box_pixels", PIXELS + "SELECT image_id, line_no, l_partkey, l_suppkey, class_id, x1, y1, x2, y2 FROM PIX")
def box_pixels(spark, sf):
    return pixels(spark, sf).select("image_id", "line_no", "l_partkey", "l_suppkey", "class_id", "x1", "y1", "x2", "y2")


@query("class_object_stats", PIXELS + "SELECT CAST(r.range AS INT) AS class_id, 'class-' || r.range AS name, count(p.class_id) AS n_boxes FROM range(10) r LEFT JOIN PIX p ON p.class_id = r.range GROUP BY r.range")
def class_object_stats(spark, sf):
    return a.class_counts(pixels(spark, sf), classes(spark))


@query("box_labels", BOX + "SELECT CASE WHEN class_id < 5 THEN 'class-' || class_id ELSE 'class_' || class_id END AS label, count(*) AS n FROM BOX GROUP BY 1")
def box_labels(spark, sf):
    return a.name_boxes(boxes(spark, sf), classes(spark).where("class_id < 5")).groupBy("label").agg(F.count("*").alias("n"))


def _lines(spark, sf) -> DataFrame:
    number = [F.col(c).cast("string") for c in ("l_linenumber", "l_quantity", "l_tax", "l_discount", "l_partkey")]
    bad = F.when(F.col("l_partkey") % 7 == 0, "invalid_line").when(F.col("l_partkey") % 7 == 1, F.concat_ws(" ", *number[:3])).otherwise(F.concat(F.lit("  "), F.concat_ws("  ", *number)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bad.alias("line"))


@query("label_text_parse", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber AS class_id, l_quantity AS xc, l_tax AS yc, l_discount AS w, l_partkey::DOUBLE AS h FROM lineitem WHERE l_partkey % 7 > 1")
def label_text_parse(spark, sf):
    return a.parse_labels(_lines(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "class_id", "xc", "yc", "w", "h")


@query("label_remap", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 2 = 0 THEN 'line ' || l_linenumber ELSE (CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE l_linenumber END) || ' ' || l_partkey END AS line FROM lineitem""")
def label_remap(spark, sf):
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("   "), F.col("l_partkey").cast("string")))
    return a.remap_lines(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line")), {1: 3, 2: 1})


@query("scan_images", "SELECT DISTINCT source || '/images/' || (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'train/' ELSE 'other/' END) || (doc_id % 300) || (CASE doc_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.jpeg' END) AS path, CASE doc_id % 3 WHEN 0 THEN 'raw' ELSE 'train' END AS split, CAST(doc_id % 300 AS VARCHAR) AS stem FROM documents WHERE doc_id % 3 < 2 AND doc_id % 5 <> 1")
def scan_images(spark, sf):
    i = F.col("doc_id")
    folder = F.when(i % 3 == 0, "").when(i % 3 == 1, "train/").otherwise("other/")
    ending = F.when(i % 5 == 0, ".PNG").when(i % 5 == 1, ".txt").otherwise(".jpeg")
    return a.scan_images(table(spark, sf, "documents").select(F.concat("source", F.lit("/images/"), folder, (i % 300).cast("string"), ending).alias("path"))).select("path", "split", "stem")


@query("pair_fallback", """WITH I AS (SELECT doc_id AS image_id, source || '/' || doc_id || '.jpg' AS rel_path, source || '/' || doc_id || '.txt' AS expected, CAST(doc_id AS VARCHAR) || '.txt' AS flat FROM documents),
L AS (SELECT CASE WHEN d.doc_id % 2 = 0 THEN source || '/' || d.doc_id || '.txt' ELSE d.doc_id || '.txt' END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT image_id, rel_path, expected, coalesce(x.p, y.p) AS label_rel_path FROM I LEFT JOIN L x ON x.p = I.expected LEFT JOIN L y ON y.p = I.flat""")
def pair_fallback(spark, sf):
    docs, i = table(spark, sf, "documents"), F.col("doc_id").cast("string")
    found = docs.select(F.col("doc_id").alias("image_id"), F.concat("source", F.lit("/"), i, F.lit(".jpg")).alias("rel_path"), i.alias("stem"))
    labels = table(spark, sf, "labels").join(docs, "doc_id").select(F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/"), i, F.lit(".txt"))).otherwise(F.concat(i, F.lit(".txt"))).alias("rel_path"))
    return a.pair_labels(found, labels).select("image_id", "rel_path", "expected", "label_rel_path")


@query("class_dictionary", "SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INT) AS class_id, p_type AS name FROM part")
def class_dictionary(spark, sf):
    names = [r[0] for r in table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").collect()]  # a handful of types
    return spark.createDataFrame(a.class_table(names), "class_id int, name string")


@query("dataset_info", IMAGES + "SELECT count(*) AS total_images, count(label_rel_path) AS total_labels, count(*) FILTER (WHERE label_rel_path IS NULL) AS unlabeled_images, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split = 'raw') AS raw FROM IMG")
def dataset_info(spark, sf):
    return a.dataset_info(images(spark, sf))


RANK = "WITH R AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)\n"


@query("partition_hash", RANK + "SELECT doc_id, pos, CASE WHEN pos < trunc(n * 0.8) THEN 'train' WHEN pos < trunc(n * 0.8) + trunc(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM R")
def partition_hash(spark, sf):
    return a.partition(table(spark, sf, "documents").select("doc_id"), "doc_id", (0.8, 0.1, 0.1))


@query("partition_counts", "SELECT split, n FROM (SELECT CAST(trunc(count(*) * 0.7) AS BIGINT) AS a, CAST(trunc(count(*) * 0.2) AS BIGINT) AS b, count(*) AS c FROM documents), LATERAL (VALUES ('train', a), ('val', b), ('test', c - a - b)) v(split, n)")
def partition_counts(spark, sf):
    done = a.repartition(table(spark, sf, "documents").select("doc_id", F.lit("train").alias("split")), "doc_id", (0.7, 0.2))
    return done.groupBy("split").agg(F.count("*").alias("n"))


def _permutation(n: int) -> str:
    """Python's own shuffle of 0 to n - 1 as an SQL list: the place of each row after it."""
    order = list(range(n))
    random.Random(42).shuffle(order)
    places = [0] * n
    for new, old in enumerate(order):
        places[old] = new
    return f"{places}::BIGINT[]"


# Python's permutation has no SQL, so it is written out for the numbers of documents of the two small fixtures.
@query("partition_mt19937", f"""WITH D AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents),
P AS (SELECT doc_id, n, CASE n WHEN 200 THEN ({_permutation(200)})[k] WHEN 1000 THEN ({_permutation(1000)})[k] END AS pos FROM D)
SELECT doc_id, pos, CASE WHEN pos < n // 2 THEN 'train' ELSE 'val' END AS split FROM P""")
def partition_mt19937(spark, sf):
    return a.partition_like_python(table(spark, sf, "documents").select("doc_id"), ["doc_id"], (0.5, 0.5, 0.0))


@query("unpartition_names", IMAGES + "SELECT flat_path, n_same, image_id FROM (SELECT stem || '.jpg' AS flat_path, count(*) AS n_same, max(image_id) AS image_id FROM IMG GROUP BY 1)")
def unpartition_names(spark, sf):
    return a.unpartition(images(spark, sf), "image_id").select("flat_path", "n_same", "image_id")


SOURCES = """WITH C AS (
  SELECT 0 AS src, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS class_id, n_name AS name FROM nation WHERE n_nationkey < 15
  UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS INT), n_name FROM nation WHERE n_nationkey >= 8),
M AS (SELECT name, CAST(row_number() OVER (ORDER BY min(src * 1000 + class_id)) - 1 AS INT) AS new_id FROM C GROUP BY name)
"""


def _dictionaries(spark, sf) -> DataFrame:
    nation = table(spark, sf, "nation")
    from pyspark.sql.window import Window

    half = lambda rows, src, order: rows.select(F.lit(src).alias("src"), (F.row_number().over(Window.orderBy(order)) - 1).alias("class_id"), F.col("n_name").alias("name"))  # noqa: E731  25 nations
    return half(nation.where("n_nationkey < 15"), 0, F.col("n_nationkey")).unionByName(half(nation.where("n_nationkey >= 8"), 1, F.desc("n_name")))


@query("merge_dictionary", SOURCES + "SELECT name, new_id FROM M")
def merge_dictionary(spark, sf):
    return a.merge_classes(_dictionaries(spark, sf))


@query("merge_boxes", SOURCES + ", B AS (SELECT CAST(l_orderkey % 2 AS INT) AS src, CAST(l_partkey % 20 AS INT) AS class_id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT B.src, B.class_id, coalesce(M.new_id, B.class_id) AS new_class, M.new_id IS NULL AS unknown, n FROM B LEFT JOIN C ON B.src = C.src AND B.class_id = C.class_id LEFT JOIN M ON C.name = M.name")
def merge_boxes(spark, sf):
    found = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 2).cast("int").alias("src"), (F.col("l_partkey") % 20).cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    return a.merge_boxes(found, _dictionaries(spark, sf)).select("src", "class_id", "new_class", "unknown", "n")


@query("merged_names", IMAGES + "SELECT image_id, 'src' || (image_id % 2) || '_' || replace(rel_path, '/', '_') AS name FROM IMG")
def merged_names(spark, sf):
    return images(spark, sf).select("image_id", a.merged_name(F.col("image_id") % 2, F.col("rel_path")).alias("name"))


@query("split_by_class", BOX + "SELECT class_id AS grp, count(*) AS n_boxes, count(DISTINCT image_id) AS n_images, max(0) AS new_class FROM BOX WHERE class_id < 5 GROUP BY class_id")
def split_by_class(spark, sf):
    return a.split_by_class(boxes(spark, sf), 5).groupBy("grp").agg(F.count("*").alias("n_boxes"), F.count_distinct("image_id").alias("n_images"), F.max("new_class").alias("new_class"))


@query("split_groups", BOX + "SELECT image_id, line_no, l_partkey, l_suppkey, g.grp, list_position(g.c, class_id) - 1 AS new_class FROM BOX, (VALUES (0, [2, 0]), (1, [3]), (2, [0, 5, 6])) g(grp, c) WHERE list_contains(g.c, class_id)")
def split_groups(spark, sf):
    return a.split_by_groups(boxes(spark, sf), [[2, 0], [3], [0, 5, 6]]).select("image_id", "line_no", "l_partkey", "l_suppkey", "grp", "new_class")


@query("split_kept_images", BOX + "SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey IN (SELECT image_id FROM BOX WHERE class_id = 6)")
def split_kept_images(spark, sf):
    return a.kept_images(table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id")), boxes(spark, sf).where("class_id = 6"))


@query("split_ratio_counts", RANK + "SELECT doc_id, CASE WHEN pos < trunc(n * 0.5) THEN 0 WHEN pos < trunc(n * 0.5) + trunc(n * 0.3) THEN 1 ELSE 2 END AS part FROM R")
def split_ratio_counts(spark, sf):
    return a.split_by_ratio(table(spark, sf, "documents").select("doc_id"), "doc_id", (0.5, 0.3, 0.2)).select("doc_id", "part")


@query("remap_names", "WITH D AS (SELECT CAST(n_nationkey AS INT) AS old, CASE n_nationkey WHEN 0 THEN 3 WHEN 7 THEN 2 ELSE n_nationkey END AS id, CASE n_nationkey WHEN 5 THEN 'renamed' ELSE n_name END AS name FROM nation) SELECT CAST(id AS INT) AS class_id, arg_max(name, old) AS name FROM D GROUP BY id")
def remap_names(spark, sf):
    return a.remap_classes(table(spark, sf, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name")), {0: 3, 7: 2}, {5: "renamed"})


@query("path_parts", IMAGES + "SELECT image_id, stem || '.jpg' AS base, stem, '.jpg' AS suffix FROM IMG")
def path_parts(spark, sf):
    rel = F.col("rel_path")
    return images(spark, sf).select("image_id", text.basename(rel).alias("base"), text.stem(rel).alias("stem"), text.suffix(rel).alias("suffix"))
