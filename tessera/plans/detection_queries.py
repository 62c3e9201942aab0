"""Detection and presentation operators over boxes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import annotations as a
from ..operators import detection as d
from ..operators import presentation as p
from ..session import table
from ..sources import media
from .annotation_queries import BOX, HEIGHT, PIXELS, WIDTH, boxes, pixels
from .registry import query

KEYS = ("image_id", "line_no", "l_partkey", "l_suppkey")


@query("max_area_filter", PIXELS + "SELECT image_id, line_no, l_partkey, l_suppkey FROM PIX WHERE (x2 - x1) * (y2 - y1) <= 0.2::DOUBLE * 640 * 480")
def max_area_filter(spark, sf):
    return d.filter_area(pixels(spark, sf), F.lit(WIDTH), F.lit(HEIGHT), 0.2).select(*KEYS)


@query("score_threshold", BOX + "SELECT image_id, line_no, l_partkey, l_suppkey, round(score, 6) AS score FROM BOX WHERE score >= 0.35::DOUBLE")
def score_threshold(spark, sf):
    return d.filter_score(boxes(spark, sf), 0.35).select(*KEYS, F.round("score", 6).alias("score"))


@query("detector_predict", "SELECT source, doc_id AS frame_index, 0 AS det_index, round(n_chars % 100 / 100, 6) AS score, lang AS label FROM documents WHERE n_chars % 100 / 100 >= 0.4")
def detector_predict(spark, sf):
    frames = table(spark, sf, "documents").select("source", F.col("doc_id").alias("frame_index"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.struct("n_chars", "lang").alias("image"))

    def detector(image, prompt, **options):
        return [(1, 1, 20, 20, image["n_chars"] % 100 / 100, image["lang"])]

    return d.Model(detector).predict(frames, "anything", box_threshold=0.4).select("source", "frame_index", "det_index", F.round("score", 6).alias("score"), "label")


@query("yolo_normalise", PIXELS + "SELECT image_id, line_no, l_partkey, l_suppkey, round((x1 + x2) / 2 / 640, 8) AS xc, round((y1 + y2) / 2 / 480, 8) AS yc, round((x2 - x1) / 640, 8) AS w, round((y2 - y1) / 480, 8) AS h FROM PIX")
def yolo_normalise(spark, sf):
    plain = pixels(spark, sf).drop("xc", "yc", "w", "h").withColumn("label", F.lit(" Box "))
    return d.normalise(plain, F.lit(WIDTH), F.lit(HEIGHT)).select(*KEYS, *(F.round(c, 8).alias(c) for c in ("xc", "yc", "w", "h")))


EVENTS = "WITH D AS (SELECT event_type AS label, event_id FROM events)\n"


@query("first_seen_classes", EVENTS + "SELECT label, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INT) AS class_id FROM D GROUP BY label")
def first_seen_classes(spark, sf):
    seen = table(spark, sf, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("label"), F.col("event_id").alias("frame_index"), F.lit(0).alias("det_index"))
    return d.class_registry(seen)


def _detections(spark, sf):
    scored = pixels(spark, sf).withColumn("label", F.concat(F.lit("class "), F.col("class_id").cast("string")))
    order = F.row_number().over(_order("image_id")) - 1
    return scored.withColumn("det_index", order)


def _order(key):
    from pyspark.sql.window import Window

    return Window.partitionBy(key).orderBy("line_no", "l_partkey", "l_suppkey", "w", "score")


DET = PIXELS.rstrip() + ", DET AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY line_no, l_partkey, l_suppkey, w, score) - 1 AS det_index FROM PIX)\n"


@query("detections_arrays", DET + "SELECT image_id, count(*) AS n_boxes, string_agg(class_id, ',' ORDER BY det_index) AS classes, round(sum(x1 * (det_index + 1)), 3)::DOUBLE AS check_x FROM DET GROUP BY image_id")
def detections_arrays(spark, sf):
    found = _detections(spark, sf).select(F.col("image_id").alias("source"), F.lit(0).alias("frame_index"), "det_index", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), "score", F.col("class_id").cast("string").alias("label"))
    rows = d.records(found)
    weighted = F.aggregate(F.transform("boxes", lambda b, i: b[0] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select(F.col("source").alias("image_id"), F.size("labels").cast("bigint").alias("n_boxes"), F.array_join("labels", ",").alias("classes"), F.round(weighted, 3).alias("check_x"))


@query("crop_names", DET + "SELECT image_id, line_no, l_partkey, l_suppkey, 'class_' || class_id || '/' || image_id || '_crop_' || (row_number() OVER (PARTITION BY image_id, class_id ORDER BY det_index) - 1) || '.jpg' AS crop_path FROM DET")
def crop_names(spark, sf):
    return p.crop_names(_detections(spark, sf), F.concat(F.lit("images/"), F.col("image_id").cast("string"), F.lit(".png"))).select(*KEYS, "crop_path")


@query("crop_dataset", DET + "SELECT image_id, line_no, l_partkey, l_suppkey, 'class_' || class_id || '/train_' || image_id || '_crop_' || (row_number() OVER (PARTITION BY image_id, class_id ORDER BY det_index) - 1) || '.jpg' AS crop_path, x2 - x1 AS width, y2 - y1 AS height FROM DET")
def crop_dataset(spark, sf):
    rel = F.concat(F.lit("train/"), F.col("image_id").cast("string"), F.lit(".png"))
    return p.crop_names(_detections(spark, sf), F.concat(p.crop_stem(rel), F.lit(".jpg"))).select(*KEYS, "crop_path", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))


@query("label_sanitize", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace('#' || p_name || ' (' || p_type || ')', '[^a-zA-Z0-9_-]+', '_', 'g'), '_'), ''), 'unknown') AS label FROM part")
def label_sanitize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.sanitise_label(F.concat(F.lit("#"), "p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("label"))


@query("grid_layout", "WITH I AS (SELECT p_partkey - 1 AS pos, CAST(p_size + 10 AS BIGINT) AS width, CAST(p_size % 7 + 5 AS BIGINT) AS height FROM part WHERE p_partkey <= 60), C AS (SELECT max(width) AS cw, max(height) AS ch FROM I) SELECT pos, pos % 12 AS grid_col, pos // 12 AS grid_row, pos % 12 * cw + (cw - width) // 2 AS x, pos // 12 * ch + (ch - height) // 2 AS y FROM I, C")
def grid_layout(spark, sf):
    images = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("pos"), (F.col("p_size") + 10).cast("bigint").alias("width"), (F.col("p_size") % 7 + 5).cast("bigint").alias("height"))
    return p.grid_layout(images, 12, 5).select("pos", "grid_col", "grid_row", "x", "y")


CROPS = """WITH K AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '/' || doc_id || '.jpg' WHEN 1 THEN source || '_crop_' || doc_id || '.png' ELSE doc_id || '.jpg' END AS path FROM documents),
R AS (SELECT path, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality WHEN K.doc_id % 3 = 0 THEN split_part(path, '/', 1) WHEN K.doc_id % 3 = 1 THEN split_part(path, '_crop_', 1) END AS label, CAST(l.toxic AS DOUBLE) AS score FROM K LEFT JOIN labels l ON K.doc_id = l.doc_id)
"""


def _crops(spark, sf):
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat("lang", F.lit("/"), i.cast("string"), F.lit(".jpg"))).when(i % 3 == 1, F.concat("source", F.lit("_crop_"), i.cast("string"), F.lit(".png"))).otherwise(F.concat(i.cast("string"), F.lit(".jpg")))
    crops = docs.select("doc_id", path.alias("path"))
    metadata = crops.join(table(spark, sf, "labels"), "doc_id").select("path", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("label"), F.col("toxic").cast("double").alias("score"))
    return p.read_crops(crops.select("path"), metadata)


@query("crops_metadata_join", CROPS + "SELECT path, label, score FROM R WHERE label IS NOT NULL")
def crops_metadata_join(spark, sf):
    return _crops(spark, sf).select("path", "label", "score")


@query("crops_by_label", CROPS + "SELECT label, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM R WHERE label IS NOT NULL GROUP BY label")
def crops_by_label(spark, sf):
    grouped = p.group_crops(_crops(spark, sf))
    return grouped.select("label", F.size("paths").cast("bigint").alias("n"), F.element_at("paths", 1).alias("first_path"), F.element_at("paths", -1).alias("last_path"))


@query("draw_anchor", PIXELS + "SELECT image_id, line_no, l_partkey, l_suppkey, x1 AS text_x, CASE WHEN y1 - 5 > 15 THEN y1 - 5 ELSE y1 + 18 END AS text_y FROM PIX")
def draw_anchor(spark, sf):
    return p.draw_anchors(pixels(spark, sf).withColumn("label", F.lit("box"))).select(*KEYS, "text_x", "text_y")


@query("frames_media", "SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS frame_index, 'stream' AS source FROM events")
def frames_media(spark, sf):
    return media.frames(table(spark, sf, "events").withColumn("stream", F.lit("stream")), "stream", "ts", "event_id").select("event_id", "frame_index", "source")


@query("crop_pixels", """WITH I AS (SELECT p_partkey AS image_id, p_partkey % 9 AS x1, p_size % 9 AS y1 FROM part)
SELECT image_id, 7 AS width, 5 AS height, string_agg(substr(md5(image_id || ':' || r), 2 * x1 + 1, 14), '' ORDER BY r) AS pixels FROM I, range(16) g(r) WHERE r BETWEEN y1 AND y1 + 4 GROUP BY image_id""")
def crop_pixels(spark, sf):
    """Grey images of 16 x 16 made of digests, cut to 7 x 5."""
    data = F.unhex(F.concat(*(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(f":{r}")).cast("binary")) for r in range(16))))
    image = F.struct(F.lit(16).alias("width"), F.lit(16).alias("height"), data.alias("data")).alias("image")
    x1, y1 = F.col("p_partkey") % 9, F.col("p_size") % 9
    cuts = table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.lit(0).alias("det_index"), x1.alias("x1"), y1.alias("y1"), (x1 + 7).alias("x2"), (y1 + 5).alias("y2"), image)
    return p.crop_pixels(cuts).select("image_id", "width", "height", F.lower(F.hex("data")).alias("pixels"))


@query("images_to_rgb", """WITH I AS (SELECT p_partkey, md5('' || p_partkey) AS h, [1, 3, 4][p_partkey % 3 + 1] AS n FROM part)
SELECT p_partkey, CASE n WHEN 1 THEN repeat(h[1:2], 3) || repeat(h[3:4], 3) WHEN 3 THEN h[5:6] || h[3:4] || h[1:2] || h[11:12] || h[9:10] || h[7:8] ELSE h[5:6] || h[3:4] || h[1:2] || h[13:14] || h[11:12] || h[9:10] END AS rgb FROM I""")
def images_to_rgb(spark, sf):
    """Two pixels of grey, BGR or BGRA."""
    n = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("p_partkey") % 3 + 1).cast("int"))
    data = F.unhex(F.md5(F.col("p_partkey").cast("string").cast("binary")))
    image = F.struct(F.lit(1).alias("height"), F.lit(2).alias("width"), n.alias("nChannels"), F.substring(data, F.lit(1), 2 * n).alias("data")).alias("image")
    return media.to_rgb(table(spark, sf, "part").select("p_partkey", image)).select("p_partkey", F.lower(F.hex("rgb")).alias("rgb"))


@query("detections_metadata", "SELECT source || '/' || doc_id AS path, 2 AS n_boxes, n_chars * 1.0::DOUBLE AS x2, 0.5::DOUBLE AS score, lang || '|' || source AS labels FROM documents")
def detections_metadata(spark, sf):
    """Metadata texts, one for each document, read as records."""
    far = F.col("n_chars").cast("double")
    box = F.array(F.lit(0.0), F.lit(0.0), far, far)
    record = F.struct(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.array(box, box).alias("boxes"), F.array(F.lit(0.5), F.lit(0.25)).alias("scores"), F.array("lang", "source").alias("labels"))
    rows = d.read_metadata(table(spark, sf, "documents").select(F.to_json(F.array(record)).alias("value")))
    return rows.select("path", F.size("boxes").alias("n_boxes"), F.col("boxes")[1][2].alias("x2"), F.col("scores")[0].alias("score"), F.array_join("labels", "|").alias("labels"))


@query("yolo_label_lines", DET + """, R AS (SELECT class_id AS c, CAST(row_number() OVER (ORDER BY min((image_id, det_index))) - 1 AS INT) AS id FROM DET GROUP BY class_id)
SELECT image_id, det_index, id AS class_id, round((y1 + y2) / 2 / 480, 6) AS yc, round((y2 - y1) / 480, 6) AS h FROM DET JOIN R ON c = class_id""")
def yolo_label_lines(spark, sf):
    """Lines of detections with ids by first appearance, read again as labels."""
    found = _detections(spark, sf).select(F.lit("s").alias("source"), F.col("image_id").alias("frame_index"), "det_index", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), "score", "label")
    lines = d.yolo_lines(found, F.lit(WIDTH), F.lit(HEIGHT))
    return a.parse_labels(lines).select(F.col("frame_index").alias("image_id"), F.col("det_index").cast("bigint").alias("det_index"), "class_id", "yc", "h")
