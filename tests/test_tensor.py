"""Tensor algebra against NumPy and pinned values."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions.types import promote
from tessera.operators import tensor as t


def test_promotion():
    assert promote("float32", "int64") == "float32" and promote("bool", "int32") == "int32" and promote("long", "double") == "float64"


def test_values(spark):
    x = t.tensor(spark, [[1, 2, 3], [4, 5, 6]])
    assert x.stride() == (3, 1) and x.t().shape == (3, 2) and len(x) == 2 and x.numel() == 6
    assert x.t().tolist() == [[1, 4], [2, 5], [3, 6]]
    assert (x + x).tolist() == [[2, 4, 6], [8, 10, 12]] and (1 - x)[0].tolist() == [0, -1, -2]
    assert x.eq(2).tolist() == [[0, 1, 0], [0, 0, 0]]
    assert x.sum().item() == 21 and x.sum(0).tolist() == [5, 7, 9] and x.mean(1).tolist() == [2, 5]
    assert x.prod().item() == 720 and x.max().item() == 6 and x.argmax(1).tolist() == [2, 2]
    assert (x @ x.t()).tolist() == [[14, 32], [32, 77]]
    assert t.tensor(spark, 42).shape == () and t.tensor(spark, 42).item() == 42
    assert t.cat([x, x], 1).shape == (2, 6) and t.stack([x, x]).sum(0).tolist() == [[2, 4, 6], [8, 10, 12]]
    assert repr(x) == "tensor([[1.0000, 2.0000, 3.0000],\n        [4.0000, 5.0000, 6.0000]])"


def test_ieee(spark):
    x = t.tensor(spark, [-1.0, 0.0, 4.0], "float64")
    logs, roots, ratio = x.log().tolist(), x.sqrt().tolist(), x.div(0).tolist()
    assert np.isnan(logs[0]) and logs[1] == -np.inf and np.isnan(roots[0]) and roots[2] == 2
    assert ratio[0] == -np.inf and np.isnan(ratio[1]) and ratio[2] == np.inf
    assert x.sqrt().ne(0).tolist() == [1, 0, 1] and x.sqrt().eq(x.sqrt()).tolist() == [0, 1, 1]
    assert x.sqrt().max().item() == 2
    assert x.clamp(0, 2).tolist() == [0, 0, 2]


def test_whole_numbers_are_cut(spark):
    x = t.tensor(spark, [1, 2, 4, -7], "int32")
    assert x.div(2).tolist() == [0, 1, 2, -3] and x.mean().item() == 0 and x.in_place("add", 0.9).tolist() == [1, 2, 4, -6]
    assert t.full(spark, (2,), 7.9, "int64").tolist() == [7, 7]


def test_empty_reductions(spark):
    x = t.zeros(spark, 0)
    assert x.sum().item() == 0 and x.prod().item() == 1 and x.all().item() is True and x.any().item() is False
    with pytest.raises(ValueError):
        x.max()
    assert t.ones(spark, 1).var().item() == 0


def test_errors(spark):
    x = t.ones(spark, 2, 3)
    for bad in (lambda: x.view(4, 2), lambda: x + t.ones(spark, 3, 2), lambda: x.split(0), lambda: x.permute(0, 0), lambda: x.unsqueeze(4), lambda: x[5], lambda: x @ x, lambda: t.tensor(spark, [[1, 2], 3]), lambda: t.tensor(spark, [[1], [2, 3]]), lambda: x.to("moon"), lambda: t.rand(spark, 2, dtype="int32")):
        with pytest.raises((ValueError, IndexError)):
            bad()
    with pytest.raises(TypeError):
        len(t.tensor(spark, 1))


def test_seed(spark):
    t.manual_seed(spark, 7)
    assert t.rand(spark, 5).tolist() == t.rand(spark, 5).tolist()


def test_elementwise_over_one_frame_needs_no_join(spark):
    x = t.ones(spark, 10, 10)
    plan = ((x + x) * x - 1).sum(0).base._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 4), min_size=1, max_size=3), st.data())
def test_shape_algebra_like_numpy(spark, shape, data):
    a = np.arange(np.prod(shape), dtype=float).reshape(shape)
    x = t.tensor(spark, a.tolist(), "float64")
    dims = data.draw(st.permutations(range(len(shape))))
    start, step = data.draw(st.integers(-5, 5)), data.draw(st.sampled_from([-2, -1, 1, 2]))
    want = np.transpose(a, dims)[start::step]
    got = x.permute(*dims)[start::step]
    assert got.shape == want.shape and got.flatten().tolist() == want.flatten().tolist()
