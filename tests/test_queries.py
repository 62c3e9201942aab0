"""Every query of the engine equals its SQL on the smallest fixture."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tessera.plans import catalog

from .conftest import SF


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_equals_sql(key, same):
    same(catalog.QUERIES[key], catalog.ORACLES[key])


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(key, spark):
    assert catalog.QUERIES[key](spark, SF).collect() is not None


def test_random_tensors_stay_in_range(spark):
    for key, n in (("tensor_rand", 10_000), ("tensor_randn", 10_000), ("tensor_randint", 10_000)):
        row = catalog.QUERIES[key](spark, SF).first()
        assert row["n"] == n and row["inside"]


def test_python_permutation(spark):
    import random

    rows = {r["doc_id"]: (r["pos"], r["split"]) for r in catalog.QUERIES["partition_mt19937"](spark, SF).collect()}
    order = sorted(rows)
    random.Random(42).shuffle(order)
    assert all(rows[d] == (k, "train" if k < len(order) // 2 else "val") for k, d in enumerate(order))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_whole_tables_are_used(spark, duck):
    assert catalog.QUERIES["zip_merge"](spark, SF).count() == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert catalog.QUERIES["tensor_matmul"](spark, SF).count() == duck.sql("SELECT count(*) * count(*) FROM embeddings").fetchall()[0][0]
    want = duck.sql("SELECT sum(ln(1 + abs(CAST(x AS DOUBLE)) / 10000)) FROM (SELECT unnest(embedding) AS x FROM embeddings)").fetchall()[0][0]
    assert abs(catalog.QUERIES["tensor_prod"](spark, SF).first()["v"] - want) < 1e-5


def test_matrix_has_the_tables_rows(spark):
    """On a table of 2,000 rows, four times the 500 of the smallest one."""
    large = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{large}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float32).astype(np.float64)
    assert x.shape == (2000, 64)
    run = lambda key: catalog.QUERIES[key](spark, large)
    assert run("tensor_numel").first().asDict() == {"n_rows": 2000, "n_cols": 64, "numel": 128_000}
    assert abs(run("tensor_mean").first()["v"] - x.mean()) < 1e-6
    assert run("tensor_mean_int").first()["v"] == np.trunc(np.trunc(x * 100).sum() / x.size)
    for key, want in (("tensor_split", x[1980:]), ("tensor_index", x[-3]), ("tensor_cat", np.concatenate((x, x))), ("tensor_view", x.reshape(400, 16, 20))):
        got = run(key).toPandas()
        at = tuple(got[f"i{k}"].to_numpy() for k in range(want.ndim))
        assert len(got) == want.size == len(set(zip(*at))), key
        assert np.array_equal(want[at], got["v"].to_numpy()), key


def test_products_at_the_middle_are_rounded_as_in_sql(spark, tmp_path):
    """Sums that times 10^5 are a whole number and a half, though their shortest decimal text is below that."""
    rows = [[1.0, 1.0, 1.0, *[0.0] * 61]]
    for y in (1.9902849999999999, -2.8985849999999997, 0.22800499999999999, -0.0000001):
        high = np.float32(y)
        mid = np.float32(y - float(high))
        rows.append([float(high), float(mid), float(np.float32(y - float(high) - float(mid))), *[0.0] * 61])
    spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[:2]: r[2] for r in con.sql(catalog.ORACLES["tensor_matmul"]).fetchall()}
    got = {(r["i0"], r["i1"]): r["v"] for r in catalog.QUERIES["tensor_matmul"](spark, str(tmp_path)).collect()}
    assert [want[0, k] for k in (1, 2, 3, 4)] == [1.99029, -2.89859, 0.22801, 0.0]
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
