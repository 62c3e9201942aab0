"""Tensor operators over the embeddings matrix and over table columns."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.types import to_double
from ..operators import tensor as t
from ..session import table
from .registry import query

COLS = 64
#: The matrix's cells and its number of rows.
E = """WITH E AS (SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
N AS (SELECT max(vec_id) + 1 AS n FROM embeddings)
"""
F32 = "CAST(CAST({} AS FLOAT) AS DOUBLE)"


def matrix(spark: SparkSession, sf: str) -> t.Tensor:
    """The table's rows up to the largest ``vec_id``."""
    rows = table(spark, sf, "embeddings")
    last = rows.agg(F.max("vec_id")).first()[0]
    return t.from_rows(rows, "vec_id", "embedding", (0 if last is None else last + 1, COLS))


def cells(x: t.Tensor, digits: int | None = None) -> DataFrame:
    value = to_double(x.value, x.dtype)
    return x.base.select(*(i.cast("bigint").alias(f"i{k}") for k, i in enumerate(x.index)), (F.round(value, digits) + F.lit(0.0) if digits else value).alias("v"))


def _register(key: str, sql: str, make, digits: int | None = None) -> None:
    query(key, sql)(lambda spark, sf: cells(make(spark, sf), digits))


def _on_matrix(key: str, sql: str, make, digits: int | None = None) -> None:
    _register(key, E + sql, lambda spark, sf: make(matrix(spark, sf)), digits)


# factories
_register("tensor_literal", "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1.0::DOUBLE), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)) AS x(i0, i1, v)", lambda s, _: t.tensor(s, [[1, 2, 3], [4, 5, 6]]))
_register("tensor_zeros", "SELECT a.range AS i0, b.range AS i1, 0.0::DOUBLE AS v FROM range(20) a, range(30) b", lambda s, _: t.zeros(s, 20, 30))
_register("tensor_ones", "SELECT a.range AS i0, b.range AS i1, 1.0::DOUBLE AS v FROM range(20) a, range(30) b", lambda s, _: t.ones(s, 20, 30, dtype="int32"))
_register("tensor_full", "SELECT a.range AS i0, b.range AS i1, 7.0::DOUBLE AS v FROM range(20) a, range(30) b", lambda s, _: t.full(s, (20, 30), 7.9, "int64"))
_register("tensor_eye", "SELECT a.range AS i0, b.range AS i1, (CASE WHEN a.range = b.range THEN 1 ELSE 0 END)::DOUBLE AS v FROM range(40) a, range(50) b", lambda s, _: t.eye(s, 40, 50))
_register("tensor_arange", "SELECT range AS i0, 2 + range * 0.25::DOUBLE AS v FROM range(392)", lambda s, _: t.arange(s, 2, 100, 0.25))
_register("tensor_linspace", "SELECT range AS i0, (CASE WHEN range = 128 THEN 1 ELSE range / 128 END)::DOUBLE AS v FROM range(129)", lambda s, _: t.linspace(s, 0, 1, 129, "float64"))
_register("tensor_empty", "SELECT a.range AS i0, b.range AS i1, 0.0::DOUBLE AS v FROM range(20) a, range(30) b", lambda s, _: t.empty(s, 20, 30))
_on_matrix("tensor_full_like", "SELECT i0, i1, 3.0::DOUBLE AS v FROM E", lambda e: t.full_like(e, 3.7, "int32"))
_on_matrix("tensor_zeros_like", "SELECT i0, i1, 0.0::DOUBLE AS v FROM E", t.zeros_like)
_on_matrix("tensor_ones_like", "SELECT i0, i1, 1.0::DOUBLE AS v FROM E", t.ones_like)


RANDOM = "SELECT 10000::BIGINT AS n, true AS inside"


def _random_facts(x: t.Tensor, low: float, high: float) -> DataFrame:
    """Count and range check: the values themselves come from Spark's generator."""
    return x.base.agg(F.count("*").alias("n"), F.coalesce(F.bool_and((x.value >= low) & (x.value <= high)), F.lit(True)).alias("inside"))


query("tensor_rand", RANDOM)(lambda s, sf: _random_facts(t.rand(s, 100, 100), 0, 1))
query("tensor_randn", RANDOM)(lambda s, sf: _random_facts(t.randn(s, 100, 100), -10, 10))
query("tensor_randint", RANDOM)(lambda s, sf: _random_facts(t.randint(s, 5, 10, (100, 100)), 5, 9))



@query("tensor_manual_seed", "SELECT 2500::BIGINT AS n, 2500::BIGINT AS same")
def tensor_manual_seed(spark, sf):
    """The same seed draws the same cells."""
    t.manual_seed(spark, 7)
    a, b = (t.rand(spark, 50, 50, dtype="float64").cells() for _ in range(2))
    return a.join(b.withColumnRenamed("v", "w"), ["i0", "i1"]).agg(F.count("*").alias("n"), F.count_if(F.col("v") == F.col("w")).alias("same"))


# introspection and values on the driver
@query("tensor_facts", """SELECT 2::BIGINT AS ndim, n AS rows, 64::BIGINT AS cols, n AS len, n * 64 AS numel, 64::BIGINT AS row_stride, 1::BIGINT AS col_stride, 0::BIGINT AS start, 4::BIGINT AS element_size,
  'float32' AS dtype, 'cpu' AS device, true AS contiguous FROM (SELECT max(vec_id) + 1 AS n FROM embeddings)""")
def tensor_facts(spark, sf):
    e = matrix(spark, sf)
    facts = (e.ndim, *e.shape, len(e), e.numel(), *e.stride(), e.offset(), e.element_size(), e.dtype, e.device, e.is_contiguous)
    return spark.createDataFrame([facts], "ndim long, rows long, cols long, len long, numel long, row_stride long, col_stride long, start long, element_size long, dtype string, device string, contiguous boolean")


@query("tensor_item", E + "SELECT max(v) AS v FROM E")
def tensor_item(spark, sf):
    return spark.createDataFrame([(matrix(spark, sf).max().item(),)], "v double")


@query("tensor_tolist", E + "SELECT i1 AS i0, min(v) AS v FROM E GROUP BY i1")
def tensor_tolist(spark, sf):
    return spark.createDataFrame(list(enumerate(matrix(spark, sf).min(0).tolist())), "i0 long, v double")


@query("tensor_repr", E + """SELECT 'tensor([' || string_agg(own, ',' || chr(10) || repeat(' ', 8) ORDER BY i0) || '])' AS text FROM (
  SELECT i1 // 8 AS i0, '[' || string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, ', ' ORDER BY i1) || ']' AS own FROM (SELECT i1, sum(v) AS x FROM E GROUP BY i1) GROUP BY i1 // 8)""")
def tensor_repr(spark, sf):
    e = matrix(spark, sf)
    signs = t.Tensor(e.base, e.index, e._number(), e.shape, "float64").sum(0).gt(0)
    return spark.createDataFrame([(repr(t.Tensor(signs.base, signs.index, signs.value.cast("int"), signs.shape, "int32").view(8, 8)),)], "text string")


@query("tensor_promote", """WITH T AS (SELECT * FROM (VALUES (0, 'bool'), (1, 'int32'), (2, 'int64'), (3, 'float32'), (4, 'float64')) x(k, name))
SELECT a.name AS a, b.name AS b, CASE WHEN a.k >= b.k THEN a.name ELSE b.name END AS both FROM T a, T b""")
def tensor_promote(spark, sf):
    names = ("bool", "int32", "int64", "float32", "float64")
    return spark.createDataFrame([(a, b, t.ones(spark, 2, dtype=a).add(t.ones(spark, 2, dtype=b)).dtype) for a in names for b in names], "a string, b string, both string")


# shape
_on_matrix("tensor_clone", "SELECT i0, i1, v FROM E", lambda e: e.clone().contiguous())
_on_matrix("tensor_to", "SELECT i0, i1, v FROM E", lambda e: e.to("cpu"))
_on_matrix("tensor_view", "SELECT (i0 * 64 + i1) // (16 * w) AS i0, (i0 * 64 + i1) // w % 16 AS i1, (i0 * 64 + i1) % w AS i2, v FROM E, (SELECT CASE WHEN n % 5 = 0 THEN 20 ELSE 4 END AS w FROM N)", lambda e: e.view(e.shape[0] // gcd(e.shape[0], 5), 16, -1))
_on_matrix("tensor_transpose", "SELECT i1 AS i0, i0 AS i1, v FROM E", lambda e: e.transpose(0, 1))
_on_matrix("tensor_t", "SELECT i1 AS i0, i0 AS i1, v FROM E", lambda e: e.t())
_on_matrix("tensor_T", "SELECT i1 % 8 AS i0, i1 // 8 AS i1, i0 AS i2, v FROM E", lambda e: e.view(-1, 8, 8).T)
_on_matrix("tensor_permute", "SELECT i1 % 8 AS i0, i0 AS i1, i1 // 8 AS i2, v FROM E", lambda e: e.view(-1, 8, 8).permute(-1, 0, 1))
_on_matrix("tensor_flatten", "SELECT i0 * 64 + i1 AS i0, v FROM E", lambda e: e.flatten())
_on_matrix("tensor_squeeze", "SELECT i0, i1, v FROM E", lambda e: e.view(-1, 1, 64, 1).squeeze())
_on_matrix("tensor_unsqueeze", "SELECT i0, 0::BIGINT AS i1, i1 AS i2, v FROM E", lambda e: e.unsqueeze(1))
_on_matrix("tensor_cat", "SELECT i0, i1, v FROM E UNION ALL SELECT i0 + n, i1, v FROM E, N", lambda e: t.cat([e, e]))
_on_matrix("tensor_stack", "SELECT i0, 0::BIGINT AS i1, i1 AS i2, v FROM E UNION ALL SELECT i0, 1, i1, v FROM E", lambda e: t.stack([e, e], 1))
_on_matrix("tensor_split", "SELECT i0 % 60 AS i0, i1, v FROM E, N WHERE i0 // 60 = (n - 1) // 60", lambda e: e.split(60)[-1])
_on_matrix("tensor_chunk", "SELECT i0, i1 - 22 AS i1, v FROM E WHERE i1 BETWEEN 22 AND 43", lambda e: e.chunk(3, 1)[1])
_on_matrix("tensor_slice", "SELECT (i0 - 10) // 7 AS i0, 63 - i1 AS i1, v FROM E WHERE i0 BETWEEN 10 AND 399 AND (i0 - 10) % 7 = 0", lambda e: e[10:400:7, ::-1])
_on_matrix("tensor_index", "SELECT i1 AS i0, v FROM E, N WHERE i0 = n - 3", lambda e: e[-3])
_on_matrix("tensor_set_item", "SELECT i0, i1, CASE WHEN i0 = 3 AND i1 >= 60 THEN 9.0 ELSE v END AS v FROM E", lambda e: e.set_item((3, slice(60, None)), 9))
query("tensor_numel", "SELECT max(vec_id) + 1 AS n_rows, 64::BIGINT AS n_cols, CAST(sum(len(embedding)) AS BIGINT) AS numel FROM embeddings")(
    lambda s, sf: (lambda e: e.base.agg(F.lit(e.shape[0]).cast("bigint").alias("n_rows"), F.lit(e.shape[1]).cast("bigint").alias("n_cols"), F.count("*").alias("numel")))(matrix(s, sf))
)
_on_matrix("tensor_where", "SELECT i0, i1, CASE WHEN v > 0 THEN v ELSE 0 END AS v FROM E", lambda e: t.where(e.gt(0), e, t.zeros_like(e)))

# element-wise
for _name, _op, _sql in (("add", "add", "v + v * 0.5"), ("sub", "sub", "v - v * 0.5"), ("mul", "mul", "v * (v * 0.5)")):
    _on_matrix(f"tensor_{_name}", f"SELECT i0, i1, {F32.format(_sql)} AS v FROM E", lambda e, op=_op: getattr(e, op)(e.mul(0.5)))
_on_matrix("tensor_add_joined", f"SELECT a.i0, a.i1, {F32.format('a.v + b.v')} AS v FROM E a JOIN E b ON a.i0 = b.i0 AND a.i1 = 63 - b.i1", lambda e: e.add(e[:, ::-1]))
_on_matrix("tensor_rsub", f"SELECT i0, i1, {F32.format('1 - v')} AS v FROM E", lambda e: 1 - e)
_on_matrix("tensor_div", f"SELECT i0, i1, {F32.format('v / ' + F32.format(F32.format('v * v') + ' + 1'))} AS v FROM E", lambda e: e.div(e.mul(e).add(1)))
_on_matrix("tensor_in_place", "SELECT i0, i1, trunc(trunc(v * 10) + 1.9::DOUBLE) + 0.0 AS v FROM E", lambda e: t.Tensor(e.base, e.index, (e._number() * 10).cast("int"), e.shape, "int32").in_place("add", 1.9))
for _name, _sql in (("sub", "v - 0.25"), ("mul", "v * 3"), ("div", "v / (1 + v * v)")):
    _on_matrix(f"tensor_in_place_{_name}", f"SELECT i0, i1, {F32.format(_sql)} AS v FROM E", lambda e, op=_name: e.in_place(op, {"sub": 0.25, "mul": 3}.get(op) or t.Tensor(e.base, e.index, 1 + e._number() * e._number(), e.shape, "float64")))
_on_matrix("tensor_fill", "SELECT i0, i1, 2.5::DOUBLE AS v FROM E", lambda e: e.fill_(2.5))
_on_matrix("tensor_zero", "SELECT i0, i1, 0.0::DOUBLE AS v FROM E", lambda e: e.zero_())
_on_matrix("tensor_pow", f"SELECT i0, i1, {F32.format('pow(v, 3)')} AS v FROM E", lambda e: e.pow(3))
_on_matrix("tensor_pow_tensor", "SELECT i0, i1, round(pow(abs(v) + 1, v), 6) AS v FROM E", lambda e: t.Tensor(e.base, e.index, F.abs(e._number()) + 1, e.shape, "float64").pow(e), 6)
_on_matrix("tensor_sqrt", f"SELECT i0, i1, {F32.format('sqrt(abs(v))')} AS v FROM E", lambda e: e.abs().sqrt())
_on_matrix("tensor_exp", f"SELECT i0, i1, round({F32.format('exp(v)')}, 6) AS v FROM E", lambda e: e.exp(), 6)
_on_matrix("tensor_log", f"SELECT i0, i1, round({F32.format(f'ln({F32.format("abs(v) + 1")})')}, 6) AS v FROM E", lambda e: e.abs().add(1).log(), 6)
_on_matrix("tensor_abs", "SELECT i0, i1, abs(v) AS v FROM E", lambda e: e.abs())
_on_matrix("tensor_neg", "SELECT i0, i1, -v AS v FROM E", lambda e: -e)
_on_matrix("tensor_clamp", "SELECT i0, i1, greatest(-0.5, least(0.25, v)) AS v FROM E", lambda e: e.clamp(-0.5, 0.25))
for _name, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _on_matrix(f"tensor_{_name}", f"SELECT i0, i1, (CASE WHEN round(v * 4) {_sign} 1 THEN 1 ELSE 0 END)::DOUBLE AS v FROM E", lambda e, op=_name: getattr(t.Tensor(e.base, e.index, F.round(e._number() * 4).cast("float"), e.shape), op)(1))

# whole-number division by a column, in the columns' own table
query("tensor_column_div", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_partkey / (l_linenumber + 1)) AS BIGINT) AS q, CAST(l_extendedprice / l_quantity AS DOUBLE) AS unit FROM lineitem")(
    lambda s, sf: (lambda c: table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c["l_partkey"].alias("q"), c["unit"].alias("unit")))(
        {
            "l_partkey": t.Tensor(None, (), F.col("l_partkey"), (), "int64").div(t.Tensor(None, (), F.col("l_linenumber") + 1, (), "int32")).value,
            "unit": t.Tensor(None, (), F.col("l_extendedprice"), (), "float64").div(t.Tensor(None, (), F.col("l_quantity"), (), "float64")).value,
        }
    )
)

# reductions
_on_matrix("tensor_sum", "SELECT round(sum(v), 3) AS v FROM E", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").sum(), 3)
_on_matrix("tensor_sum_dim0", "SELECT i1 AS i0, round(sum(v), 6) AS v FROM E GROUP BY i1", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").sum(0), 6)
_on_matrix("tensor_sum_dim1", "SELECT i0, 0::BIGINT AS i1, round(sum(v), 6) AS v FROM E GROUP BY i0", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").sum(-1, keepdim=True), 6)
_on_matrix("tensor_sum_bool", "SELECT count(*) FILTER (WHERE v > 0)::DOUBLE AS v FROM E", lambda e: t.Tensor(e.base, e.index, e.value > 0, e.shape, "bool").sum())
_on_matrix("tensor_mean", "SELECT round(avg(v), 6) AS v FROM E", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").mean(), 6)
_on_matrix("tensor_mean_int", "SELECT trunc(sum(CAST(trunc(v * 100) AS BIGINT)) / (64 * max(n))) + 0.0 AS v FROM E, N", lambda e: t.Tensor(e.base, e.index, (e._number() * 100).cast("bigint"), e.shape, "int64").mean())
_on_matrix("tensor_mean_dim1", "SELECT i0, round(sum(v) / 64, 6) AS v FROM E GROUP BY i0", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").mean(1), 6)
_on_matrix("tensor_prod", "SELECT round(ln(product(1 + abs(v) / 10000)), 6) AS v FROM E", lambda e: t.Tensor(e.base, e.index, 1 + F.abs(e._number()) / 10000, e.shape, "float64").prod().log(), 6)
_on_matrix("tensor_max", "SELECT max(v) AS v FROM E", lambda e: e.max())
_on_matrix("tensor_min", "SELECT min(v) AS v FROM E", lambda e: e.min())
_on_matrix("tensor_max_dim", "SELECT i0, max(v) AS v FROM E GROUP BY i0", lambda e: e.max(1))
_on_matrix("tensor_argmax", "SELECT i0, arg_min(i1, (-v, i1))::DOUBLE AS v FROM E GROUP BY i0", lambda e: e.argmax(1))
_on_matrix("tensor_argmin", "SELECT i1 AS i0, arg_min(i0, (v, i0))::DOUBLE AS v FROM E GROUP BY i1", lambda e: e.argmin(0))
_on_matrix("tensor_var", "SELECT round(var_samp(v), 6) AS v FROM E", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").var(), 6)
_on_matrix("tensor_std", "SELECT round(stddev_pop(v), 6) AS v FROM E", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").std(unbiased=False), 6)
_on_matrix("tensor_prod_dim", "SELECT i0, round(product(1 + abs(v) / 100), 6) AS v FROM E GROUP BY i0", lambda e: t.Tensor(e.base, e.index, 1 + F.abs(e._number()) / 100, e.shape, "float64").prod(1), 6)
_on_matrix("tensor_min_dim", "SELECT i1 AS i0, min(v) AS v FROM E GROUP BY i1", lambda e: e.min(0))
_on_matrix("tensor_var_dim", "SELECT i0, round(var_pop(v), 6) AS v FROM E GROUP BY i0", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").var(False, 1), 6)
_on_matrix("tensor_std_dim", "SELECT i1 AS i0, round(stddev_samp(v), 6) AS v FROM E GROUP BY i1", lambda e: t.Tensor(e.base, e.index, e._number(), e.shape, "float64").std(True, 0), 6)
_on_matrix("tensor_all_dim", "SELECT i0, (CASE WHEN bool_and(v > -0.9) THEN 1 ELSE 0 END)::DOUBLE AS v FROM E GROUP BY i0", lambda e: e.gt(-0.9).all(1))
_on_matrix("tensor_all", "SELECT (CASE WHEN bool_and(v <> 0) THEN 1 ELSE 0 END)::DOUBLE AS v FROM E", lambda e: e.all())
_on_matrix("tensor_any", "SELECT i0, (CASE WHEN bool_or(v > 0.9) THEN 1 ELSE 0 END)::DOUBLE AS v FROM E GROUP BY i0", lambda e: e.gt(0.9).any(1))


def _gram(e: t.Tensor) -> t.Tensor:
    """Rows by rows, to five digits."""
    x = t.Tensor(e.base, e.index, e._number(), e.shape, "float64")
    made = x.matmul(x.t())
    return t.Tensor(made.base, made.index, ieee.round_to(made.value, 5) + F.lit(0.0), made.shape, made.dtype)


_on_matrix("tensor_matmul", "SELECT a.i0, b.i0 AS i1, round(sum(a.v * b.v), 5) + 0.0 AS v FROM E a JOIN E b ON a.i1 = b.i1 GROUP BY a.i0, b.i0", _gram)
