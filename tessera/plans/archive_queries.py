"""Archive, configuration and JSON operators over member tables derived from the fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import archive as z
from ..operators import config
from ..session import table
from .registry import query

MEMBERS = """WITH M AS (
  SELECT source AS archive, doc_id AS ord, source || '/' || doc_id || '.txt' AS name, n_chars AS file_size, n_chars // 3 AS compress_size FROM documents)
"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """An archive for each source, a member for each document."""
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("archive"), F.col("doc_id").alias("ord"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("n_chars").alias("file_size"), F.expr("n_chars div 3").alias("compress_size"))


@query("zip_list", MEMBERS + "SELECT archive, ord, name FROM M ORDER BY archive, ord")
def zip_list(spark, sf):
    return z.list_files(members(spark, sf))


@query("zip_search", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*[a-m]o?d*'")
def zip_search(spark, sf):
    return z.search(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")), "*[a-m]o?d*").withColumnRenamed("name", "p_name")


@query("zip_info", MEMBERS + "SELECT archive, count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size, CAST(sum(compress_size) AS BIGINT) AS compressed_size, round((1 - sum(compress_size) / sum(file_size)) * 100, 2) AS ratio FROM M GROUP BY archive")
def zip_info(spark, sf):
    return z.info(members(spark, sf))


@query("zip_test", "SELECT source AS archive, arg_min(CAST(doc_id AS VARCHAR), doc_id) AS name FROM documents WHERE doc_id % 40 = 0 AND text <> '' GROUP BY source")  # the others' checksums are their own
def zip_test(spark, sf):
    docs = table(spark, sf, "documents")
    stored = docs.select(F.col("source").alias("archive"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 40 == 0, 0).otherwise(F.crc32("text")).alias("crc"))
    return z.first_bad(stored)


@query("zip_extract_file", MEMBERS + "SELECT archive, ord, name, file_size, compress_size, '7.txt' AS target FROM M WHERE name = 'src17/7.txt' OR name = (SELECT name FROM M WHERE ord = 7)")
def zip_extract_file(spark, sf):
    own = members(spark, sf)
    return z.extract_file(own, own.where("ord = 7").first()["name"])


@query("zip_remove", MEMBERS + "SELECT archive, ord, name FROM M WHERE ord NOT IN (SELECT doc_id FROM labels)")
def zip_remove(spark, sf):
    own = members(spark, sf)
    gone = own.join(table(spark, sf, "labels").select(F.col("doc_id").alias("ord")), "ord").select("name")
    return z.remove(own, gone).select("archive", "ord", "name")


@query("zip_merge", MEMBERS + "SELECT 'all.zip' AS archive, archive AS from_archive, row_number() OVER (ORDER BY archive, ord) - 1 AS ord, name FROM M")
def zip_merge(spark, sf):
    return z.merge(members(spark, sf), "all.zip").select("archive", "from_archive", "ord", "name")


@query("zip_add_dup", """WITH A AS (SELECT p_brand AS archive, p_partkey AS ord, p_name || '.txt' AS name FROM part WHERE p_partkey % 2 = 0),
B AS (SELECT p_brand AS archive, p_partkey AS ord, p_name || '.txt' AS name FROM part WHERE p_partkey % 2 = 1),
T AS (SELECT DISTINCT archive, name FROM A), L AS (SELECT archive, max(ord) + 1 AS nxt FROM A GROUP BY archive),
N AS (SELECT B.*, T.name IS NOT NULL AS taken, row_number() OVER (PARTITION BY B.archive, B.name ORDER BY B.ord) AS k FROM B LEFT JOIN T ON B.archive = T.archive AND B.name = T.name)
SELECT * FROM A UNION ALL SELECT N.archive, N.ord + coalesce(L.nxt, 0), CASE WHEN taken THEN substr(name, 1, length(name) - 4) || '_dup' || (CASE WHEN k = 1 THEN '' ELSE CAST(k AS VARCHAR) END) || '.txt' ELSE name END FROM N LEFT JOIN L ON N.archive = L.archive""")
def zip_add_dup(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("archive"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(".txt")).alias("name"))
    return z.add(parts.where("ord % 2 = 0"), parts.where("ord % 2 = 1"))


@query("zip_next_fit", MEMBERS + """, O AS (SELECT archive, ord, compress_size, row_number() OVER (PARTITION BY archive ORDER BY ord) AS k FROM M),
F AS (
  SELECT archive, ord, k, 1::BIGINT AS part, compress_size AS used FROM O WHERE k = 1
  UNION ALL
  SELECT O.archive, O.ord, O.k, CASE WHEN F.used + O.compress_size > 20000 THEN F.part + 1 ELSE F.part END, CASE WHEN F.used + O.compress_size > 20000 THEN O.compress_size ELSE F.used + O.compress_size END
  FROM F JOIN O ON O.archive = F.archive AND O.k = F.k + 1)
SELECT archive, ord, part, archive || '_part_' || lpad(CAST(part AS VARCHAR), 3, '0') || '.zip' AS file FROM F""")
def zip_next_fit(spark, sf):
    return z.split_by_size(members(spark, sf), 20_000).select("archive", "ord", "part", z.part_name(F.col("archive"), F.col("part")).alias("file"))


from .registry import ORACLES  # noqa: E402

ORACLES["zip_next_fit"] = ORACLES["zip_next_fit"].replace("WITH M AS", "WITH RECURSIVE M AS", 1)
#: Sizes with empty members and with members over the limit.
UNEVEN = "CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 30000 ELSE compress_size END"


@query("zip_next_fit_empty", ORACLES["zip_next_fit"].replace("(SELECT archive, ord, compress_size, ", f"(SELECT archive, ord, {UNEVEN} AS compress_size, ").replace("O AS (SELECT archive, ord, compress_size,", f"O AS (SELECT archive, ord, CAST({UNEVEN} AS BIGINT) AS compress_size,"))
def zip_next_fit_empty(spark, sf):
    own = members(spark, sf).withColumn("compress_size", F.expr(f"CAST({UNEVEN} AS BIGINT)"))
    return z.split_by_size(own, 20_000).select("archive", "ord", "part", z.part_name(F.col("archive"), F.col("part")).alias("file"))


@query("human_size", """WITH S AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * l_partkey * (1::BIGINT << (3 * l_linenumber))) AS n FROM lineitem),
U AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM S)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', n / (1::BIGINT << (10 * k))) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] AS size FROM U""")
def human_size(spark, sf):
    n = F.col("l_partkey") * F.col("l_partkey") * F.expr("shiftleft(1L, 3 * l_linenumber)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.human_size(n).alias("size"))


@query("config_expand", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 5 > 0 THEN '/data/' || p_name ELSE './' || p_name END AS value FROM part")
def config_expand(spark, sf):
    path = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("root"))).when(F.col("p_size") % 5 == 0, F.array(F.lit("default"), F.lit("x"))).otherwise(F.array(F.col("p_brand"), F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", config.expand_value(path, F.concat(F.lit("./"), F.col("p_name")), F.lit("/data")).alias("value"))


@query("json_props", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _nations(spark: SparkSession, sf: str) -> dict:
    """Nations with their keys below their regions, as a configuration tree."""
    region = F.broadcast(table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    tree: dict = {}
    for r in table(spark, sf, "nation").join(region, "n_regionkey").orderBy("r_name", "n_name").collect():  # 25 nations
        tree.setdefault(r["r_name"], {})[r["n_name"]] = r["n_nationkey"]
    return tree


NATIONS = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("config_formats", f"SELECT format, [r_name, n_name] AS path, CAST(n_nationkey AS VARCHAR) AS value {NATIONS}, (VALUES ('.json'), ('.toml'), ('.yaml')) f(format)")
def config_formats(spark, sf):
    """The tree written in each format and read again."""
    tree = _nations(spark, sf)
    return reduce(DataFrame.unionAll, (config.table(spark, config.loads(config.dumps(tree, s), s)).select(F.lit(s).alias("format"), "path", "value") for s in (".json", ".toml", ".yaml")))


@query("config_assign", f"SELECT [r_name, n_name] AS path, CAST(CASE WHEN r_name = (SELECT min(r_name) FROM region) THEN n_nationkey + 100 ELSE n_nationkey END AS VARCHAR) AS value {NATIONS}")
def config_assign(spark, sf):
    """Entries below the first region, read and set by their paths."""
    tree = _nations(spark, sf)
    first = min(tree)
    for name in tree[first]:
        config.assign(tree, config.get_value(tree, first, name) + 100, first, name)
    return config.table(spark, tree)


@query("config_tree_expand", f"SELECT [r_name, n_name] AS path, '/data/' || n_name AS value {NATIONS} UNION ALL SELECT ['default', 'root'], '/data'")
def config_tree_expand(spark, sf):
    tree = {"default": {"root": "/data"}} | {region: {name: f"./{name}" for name in names} for region, names in _nations(spark, sf).items()}
    return config.table(spark, config.expand(tree))
