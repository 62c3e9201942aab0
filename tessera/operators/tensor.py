"""Tensors as DataFrames of cells.

A tensor is a frame with a row per cell, an expression for each index, one for
the value, a shape and a dtype.  Shape operators only rewrite index
expressions.  Element-wise operators of tensors over the same frame and index
rewrite the value expression; others join on the index.  Reductions are
aggregations, with partial sums before the shuffle.

Arithmetic is in double and cast to the result's dtype, so whole numbers are
cut toward zero.  Sums accumulate in double along every dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.types import SPARK_TYPES, dtype_of, fill, from_double, is_float, promote, to_double

#: Rows and columns of the blocks that are multiplied.
BLOCK = 256
#: Cells of a product that a task makes, about and at most.
CELLS = 1 << 22


def strides(shape: Sequence[int]) -> tuple[int, ...]:
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= n
    return tuple(reversed(out))


@dataclass(frozen=True, eq=False)
class Tensor:
    base: DataFrame
    index: tuple[Column, ...]
    value: Column
    shape: tuple[int, ...]
    dtype: str = "float32"

    # -- introspection ----------------------------------------------------
    @property
    def ndim(self) -> int:
        return len(self.shape)

    def numel(self) -> int:
        return math.prod(self.shape)

    def stride(self) -> tuple[int, ...]:
        return strides(self.shape)

    def element_size(self) -> int:
        return {"bool": 1, "int32": 4, "int64": 8, "float32": 4, "float64": 8}[self.dtype]

    def offset(self) -> int:
        return 0

    @property
    def is_contiguous(self) -> bool:
        return True

    @property
    def device(self) -> str:
        return "cpu"

    def contiguous(self) -> Tensor:
        return self

    def clone(self) -> Tensor:
        return self

    def to(self, device: str) -> Tensor:
        """Devices are Spark's business; only names are checked."""
        if device.lower().split(":")[0] not in ("cpu", "cuda"):
            raise ValueError(f"unknown device: {device}")
        return self

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("len() of a 0-d tensor")
        return self.shape[0]

    def cells(self) -> DataFrame:
        """Columns i0, i1, ... and v."""
        return self.base.select(*(x.cast("bigint").alias(f"i{k}") for k, x in enumerate(self.index)), self.value.alias("v"))

    def rebase(self) -> Tensor:
        """The same tensor over its own cells."""
        cells = self.cells()
        return replace(self, base=cells, index=tuple(cells[f"i{k}"] for k in range(self.ndim)), value=cells["v"])

    def item(self):
        if self.numel() != 1:
            raise ValueError("item() needs exactly one element")
        return self.cells().first()["v"]

    def tolist(self):
        """Nested lists of floats, whatever the dtype."""
        rows = {tuple(r)[:-1]: r["v"] for r in self.cells().collect()}

        def build(at: tuple[int, ...]):
            if len(at) == self.ndim:
                return float(rows[at])
            return [build((*at, i)) for i in range(self.shape[len(at)])]

        return build(())

    def __repr__(self) -> str:
        if self.numel() > 1000:
            return f"tensor(shape={self.shape}, dtype={self.dtype})"
        return f"tensor({_text(self.tolist(), self.dtype, 7)})"

    # -- shape ------------------------------------------------------------
    def _dim(self, dim: int, size: int | None = None) -> int:
        size = self.ndim if size is None else size
        if not -size <= dim < size:
            raise IndexError(f"dimension {dim} out of range for {size}")
        return dim % size

    def view(self, *shape: int) -> Tensor:
        """Row-major reshape; one -1 is inferred."""
        shape = tuple(shape[0]) if len(shape) == 1 and isinstance(shape[0], (tuple, list)) else shape
        if list(shape).count(-1) > 1:
            raise ValueError("only one dimension can be inferred")
        if -1 in shape:
            rest = -math.prod(shape)
            if rest <= 0 or self.numel() % rest:
                raise ValueError("shape mismatch in view")
            shape = tuple(self.numel() // rest if n == -1 else n for n in shape)
        if math.prod(shape) != self.numel():
            raise ValueError("shape mismatch in view")
        flat = reduce(lambda a, b: a + b, (x * F.lit(s).cast("bigint") for x, s in zip(self.index, self.stride())), F.lit(0).cast("bigint"))
        index = tuple(_div(flat, s) % F.lit(n) for s, n in zip(strides(shape), shape))
        return replace(self, index=index, shape=shape)

    reshape = view

    def permute(self, *dims: int) -> Tensor:
        dims = tuple(self._dim(d) for d in (dims[0] if len(dims) == 1 and isinstance(dims[0], (tuple, list)) else dims))
        if sorted(dims) != list(range(self.ndim)):
            raise ValueError("permute needs every dimension once")
        return replace(self, index=tuple(self.index[d] for d in dims), shape=tuple(self.shape[d] for d in dims))

    def transpose(self, dim0: int, dim1: int) -> Tensor:
        dims = list(range(self.ndim))
        dims[self._dim(dim0)], dims[self._dim(dim1)] = dims[self._dim(dim1)], dims[self._dim(dim0)]
        return self.permute(*dims)

    def t(self) -> Tensor:
        if self.ndim > 2:
            raise ValueError("t() needs at most two dimensions")
        return self.transpose(0, 1) if self.ndim == 2 else self

    @property
    def T(self) -> Tensor:
        return self.permute(*reversed(range(self.ndim)))

    def flatten(self, start_dim: int = 0, end_dim: int = -1) -> Tensor:
        if not self.shape:
            return self.view(1)
        a, b = self._dim(start_dim), self._dim(end_dim)
        if a > b:
            raise ValueError("start_dim after end_dim")
        return self.view(*self.shape[:a], math.prod(self.shape[a : b + 1]), *self.shape[b + 1 :])

    def squeeze(self, dim: int | None = None) -> Tensor:
        drop = {k for k, n in enumerate(self.shape) if n == 1 and (dim is None or k == self._dim(dim))}
        keep = [k for k in range(self.ndim) if k not in drop]
        return replace(self, index=tuple(self.index[k] for k in keep), shape=tuple(self.shape[k] for k in keep))

    def unsqueeze(self, dim: int) -> Tensor:
        at = self._dim(dim, self.ndim + 1)
        return replace(self, index=(*self.index[:at], F.lit(0).cast("bigint"), *self.index[at:]), shape=(*self.shape[:at], 1, *self.shape[at:]))

    def __getitem__(self, key) -> Tensor:
        """Whole numbers, slices and tuples of them, by Python's rules."""
        key = key if isinstance(key, tuple) else (key,)
        if len(key) > self.ndim:
            raise IndexError("too many indices")
        kept, index, shape = [], [], []
        for k, (x, n) in enumerate(zip(self.index, self.shape)):
            one = key[k] if k < len(key) else slice(None)
            if isinstance(one, int):
                if not -n <= one < n:
                    raise IndexError(f"index {one} out of range for size {n}")
                kept.append(x == one % n)
                continue
            if not isinstance(one, slice):
                raise TypeError(f"bad index: {one!r}")
            wanted = range(*one.indices(n))
            shape.append(len(wanted))
            if one.step in (None, 1) and len(wanted) == n:
                index.append(x)
                continue
            low, high = (min(wanted), max(wanted)) if wanted else (0, -1)
            kept.append((x >= low) & (x <= high) & ((x - F.lit(wanted.start)) % F.lit(abs(wanted.step)) == 0))
            index.append(_div(x - F.lit(wanted.start), abs(wanted.step)) * (1 if wanted.step > 0 else -1))
        base = self.base.where(reduce(lambda a, b: a & b, kept)) if kept else self.base
        return replace(self, base=base, index=tuple(index), shape=tuple(shape))

    def set_item(self, key, value: float) -> Tensor:
        """A tensor with the cells under ``key`` set to ``value``."""
        self[key]  # checks the key
        key = key if isinstance(key, tuple) else (key,)
        conditions = []
        for x, n, one in zip(self.index, self.shape, key):
            wanted = [one % n] if isinstance(one, int) else list(range(*one.indices(n)))
            conditions.append(x.isin(wanted) if wanted else F.lit(False))
        return replace(self, value=F.when(reduce(lambda a, b: a & b, conditions), fill(value, self.dtype)).otherwise(self.value))

    def split(self, size: int, dim: int = 0) -> list[Tensor]:
        if size <= 0:
            raise ValueError("split size must be positive")
        at = self._dim(dim)
        return [self[(*[slice(None)] * at, slice(a, a + size))] for a in range(0, self.shape[at], size)]

    def chunk(self, chunks: int, dim: int = 0) -> list[Tensor]:
        if chunks <= 0:
            raise ValueError("chunks must be positive")
        return self.split(max(1, -(-self.shape[self._dim(dim)] // chunks)), dim)

    # -- element-wise -----------------------------------------------------
    def _number(self) -> Column:
        return to_double(self.value, self.dtype)

    def _same(self, other: Tensor) -> tuple[Tensor, Tensor]:
        """Both over one frame: as they are, or joined on the index."""
        if self.shape != other.shape:
            raise ValueError("Shape mismatch")
        if self.base is other.base and all(str(a) == str(b) for a, b in zip(self.index, other.index)):
            return self, other
        a, b = self.cells().alias("a"), other.cells().alias("b")
        on = [F.col(f"a.i{k}") == F.col(f"b.i{k}") for k in range(self.ndim)] or [F.lit(True)]
        both = a.join(b, on).select(*(F.col(f"a.i{k}").alias(f"i{k}") for k in range(self.ndim)), F.col("a.v").alias("v"), F.col("b.v").alias("w"))
        index = tuple(F.col(f"i{k}") for k in range(self.ndim))
        return replace(self, base=both, index=index, value=F.col("v")), replace(other, base=both, index=index, value=F.col("w"))

    def _binary(self, other, op, dtype: str | None = None) -> Tensor:
        if isinstance(other, Tensor):
            a, b = self._same(other)
            dtype = dtype or promote(a.dtype, b.dtype)
            return replace(a, value=from_double(op(a._number(), b._number()), dtype), dtype=dtype)
        return replace(self, value=from_double(op(self._number(), F.lit(float(other))), self.dtype))

    def add(self, other) -> Tensor:
        return self._binary(other, lambda a, b: a + b)

    def sub(self, other) -> Tensor:
        return self._binary(other, lambda a, b: a - b)

    def mul(self, other) -> Tensor:
        return self._binary(other, lambda a, b: a * b)

    def div(self, other) -> Tensor:
        return self._binary(other, ieee.divide)

    def pow(self, other) -> Tensor:
        return self._binary(other, F.pow)

    __add__, __radd__, __sub__, __mul__, __rmul__, __truediv__, __pow__ = add, add, sub, mul, mul, div, pow

    def __rsub__(self, other) -> Tensor:
        return self.mul(-1).add(other)

    def in_place(self, op: str, other) -> Tensor:
        """add_, sub_, mul_ and div_: the result keeps this tensor's dtype."""
        out = getattr(self, op)(other)
        return replace(out, value=from_double(out._number(), self.dtype), dtype=self.dtype)

    def fill_(self, value: float) -> Tensor:
        return replace(self, value=fill(value, self.dtype))

    def zero_(self) -> Tensor:
        return self.fill_(0)

    def _unary(self, op) -> Tensor:
        return replace(self, value=from_double(op(self._number()), self.dtype))

    def sqrt(self) -> Tensor:
        return self._unary(F.sqrt)

    def exp(self) -> Tensor:
        return self._unary(F.exp)

    def log(self) -> Tensor:
        return self._unary(ieee.log)

    def abs(self) -> Tensor:
        return self._unary(F.abs)

    def neg(self) -> Tensor:
        return self._unary(F.negative)

    __neg__ = neg

    def clamp(self, min: float = -1e300, max: float = 1e300) -> Tensor:
        return self._unary(lambda x: ieee.clamp(x, min, max))

    def _compare(self, op: str, other) -> Tensor:
        """0 or 1 in the operands' dtype."""
        return self._binary(other, lambda a, b: ieee.compare(op, a, b).cast("int").cast("double"))

    def eq(self, other) -> Tensor:
        return self._compare("eq", other)

    def ne(self, other) -> Tensor:
        return self._compare("ne", other)

    def lt(self, other) -> Tensor:
        return self._compare("lt", other)

    def le(self, other) -> Tensor:
        return self._compare("le", other)

    def gt(self, other) -> Tensor:
        return self._compare("gt", other)

    def ge(self, other) -> Tensor:
        return self._compare("ge", other)

    # -- reductions -------------------------------------------------------
    def _reduce(self, make, dtype: str, dim: int | None = None, keepdim: bool = False) -> Tensor:
        """``make`` takes the value as a double and gives an aggregate."""
        if dim is None:
            out = self.base.agg(make(self._number()).alias("v"))
            return Tensor(out, (), F.col("v").cast(SPARK_TYPES[dtype]), (), dtype)
        at = self._dim(dim)
        keep = [k for k in range(self.ndim) if k != at]
        out = self.base.groupBy(*(self.index[k].alias(f"i{n}") for n, k in enumerate(keep))).agg(make(self._number()).alias("v"))
        index = tuple(F.col(f"i{n}") for n in range(len(keep)))
        done = Tensor(out, index, from_double(F.col("v"), dtype) if dtype != "bool" else F.col("v"), tuple(self.shape[k] for k in keep), dtype)
        return done.unsqueeze(at) if keepdim else done

    @property
    def _sum_dtype(self) -> str:
        return "int64" if self.dtype == "bool" else self.dtype

    def sum(self, dim: int | None = None, keepdim: bool = False) -> Tensor:
        return self._reduce(lambda v: F.coalesce(F.sum(v), F.lit(0.0)), self._sum_dtype, dim, keepdim)

    def mean(self, dim: int | None = None, keepdim: bool = False) -> Tensor:
        """The sum in its dtype by the count, so whole numbers are cut."""
        n = self.numel() if dim is None else self.shape[self._dim(dim)]
        return self.sum(dim, keepdim).div(n)

    def prod(self, dim: int | None = None) -> Tensor:
        return self._reduce(lambda v: F.coalesce(F.product(v), F.lit(1.0)), self.dtype, dim)

    def _extreme(self, make, dim: int | None) -> Tensor:
        if not self.numel():
            raise ValueError("no elements")
        return self._reduce(lambda v: F.coalesce(make(F.when(~F.isnan(v), v)), F.lit(ieee.NAN)), self.dtype, dim)

    def max(self, dim: int | None = None) -> Tensor:
        """Largest value; NaN only if there is nothing else."""
        return self._extreme(F.max, dim)

    def min(self, dim: int | None = None) -> Tensor:
        return self._extreme(F.min, dim)

    def _arg(self, pick, dim: int) -> Tensor:
        at = self._dim(dim)
        place = self.index[at]
        keep = [k for k in range(self.ndim) if k != at]
        value = F.struct(pick(self._number()).alias("v"), place.cast("bigint").alias("i"))
        out = self.base.groupBy(*(self.index[k].alias(f"i{n}") for n, k in enumerate(keep))).agg(F.min(value)["i"].alias("v"))
        return Tensor(out, tuple(F.col(f"i{n}") for n in range(len(keep))), F.col("v"), tuple(self.shape[k] for k in keep), "int64")

    def argmax(self, dim: int) -> Tensor:
        """Index of the first largest value."""
        return self._arg(lambda v: -v, dim)

    def argmin(self, dim: int) -> Tensor:
        return self._arg(lambda v: v, dim)

    def var(self, unbiased: bool = True, dim: int | None = None) -> Tensor:
        """Variance; one element gives 0."""
        n = self.numel() if dim is None else self.shape[self._dim(dim)]
        make = F.var_samp if unbiased and n > 1 else F.var_pop
        return self._reduce(lambda v: F.coalesce(make(v), F.lit(0.0)), self.dtype, dim)

    def std(self, unbiased: bool = True, dim: int | None = None) -> Tensor:
        return self.var(unbiased, dim).sqrt()

    def all(self, dim: int | None = None) -> Tensor:
        return self._reduce(lambda v: F.coalesce(F.bool_and(v != 0), F.lit(True)), "bool", dim)

    def any(self, dim: int | None = None) -> Tensor:
        return self._reduce(lambda v: F.coalesce(F.bool_or(v != 0), F.lit(False)), "bool", dim)

    def matmul(self, other: Tensor) -> Tensor:
        """Rows by columns, in blocks: each pair of blocks is multiplied, and partial products are summed by cell.

        Cells are dealt once, into dense blocks of ``BLOCK`` x ``BLOCK`` (narrower where k is).  Each task reads one partition of
        blocks of either side where they lie, so no copy of a block is written, however many it meets.
        Cells that a sparse side lacks count as 0.
        """
        if self.ndim != 2 or other.ndim != 2 or self.shape[1] != other.shape[0]:
            raise ValueError("matmul needs (n, k) and (k, m)")
        dtype, size = promote(self.dtype, other.dtype), BLOCK
        deep = min(size, self.shape[1])  # of a block: the columns that there are
        parts = math.isqrt(self.shape[0] * other.shape[1] // CELLS) + 1

        def pack(table: pa.Table) -> pa.Table:
            b, bk = table["b"][0].as_py(), table["bk"][0].as_py()
            rows, at = np.unique(table["i"].to_numpy(), return_inverse=True)
            dense = np.zeros((len(rows), deep))
            dense[at, table["k"].to_numpy() - bk * size] = table["v"].to_numpy()
            return pa.table({"b": [b], "bk": [bk], "i": pa.array([rows.astype("<i8").tobytes()], pa.binary()), "v": pa.array([dense.tobytes()], pa.binary())})

        def blocks(x: Tensor, i: int, k: int) -> DataFrame:
            cells = x.base.select(x.index[i].alias("i"), x.index[k].alias("k"), x._number().alias("v"))
            keyed = cells.select(_div(F.col("i"), size).alias("b"), _div(F.col("k"), size).alias("bk"), "i", "k", "v")
            packed = keyed.groupBy("b", "bk").applyInArrow(pack, "b long, bk long, i binary, v binary")
            return packed.repartition(parts, "b", "bk").drop("b")  # else every task that reads a block would pack it anew

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for found in zip(*batch.columns):
                    rows, cols = (np.frombuffer(x.as_buffer(), "<i8") for x in found[:2])
                    x, y = (np.frombuffer(v.as_buffer(), "<f8").reshape(len(at), deep) for v, at in zip(found[2:], (rows, cols)))
                    cells = np.repeat(rows, len(cols)), np.tile(cols, len(rows)), (x @ y.T).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i0", "i1", "v"])

        left, right = blocks(self, 0, 1), blocks(other, 1, 0).toDF("bk_", "i_", "v_")
        pairs = left.hint("shuffle_replicate_nl").join(right, F.col("bk") == F.col("bk_"))
        out = pairs.select("i", "i_", "v", "v_").mapInArrow(multiply, "i0 long, i1 long, v double")
        if self.shape[1] > size:
            out = out.groupBy("i0", "i1").agg(F.sum("v").alias("v"))
        return Tensor(out, (F.col("i0"), F.col("i1")), from_double(F.col("v"), dtype), (self.shape[0], other.shape[1]), dtype)

    __matmul__ = matmul


def _div(x: Column, n: int) -> Column:
    """Whole division of a bigint expression that ``n`` divides or that is not negative."""
    return x if n == 1 else F.call_function("div", x, F.lit(n))


def _text(x, dtype: str, pad: int) -> str:
    if not isinstance(x, list):
        if dtype == "bool":
            return str(bool(x))
        return f"{x:.4f}" if is_float(dtype) else str(int(x))
    if not x or not isinstance(x[0], list):
        return "[" + ", ".join(_text(y, dtype, pad) for y in x) + "]"
    depth, y = 0, x
    while isinstance(y, list) and y and isinstance(y[0], list):
        depth, y = depth + 1, y[0]
    gap = "," + "\n" * max(1, depth) + " " * (pad + 1)
    return "[" + gap.join(_text(y, dtype, pad + 1) for y in x) + "]"


# -- factories ------------------------------------------------------------
def _shape(shape) -> tuple[int, ...]:
    shape = tuple(shape[0]) if len(shape) == 1 and isinstance(shape[0], (tuple, list)) else tuple(shape)
    if any(n < 0 for n in shape):
        raise ValueError("negative size")
    return shape


def over_range(spark: SparkSession, shape: Sequence[int], value: Column | None, dtype: str) -> Tensor:
    """A tensor over ``spark.range``; ``value`` may use the flat position ``id``."""
    shape = tuple(shape)
    base = spark.range(math.prod(shape))
    index = tuple(_div(F.col("id"), s) % F.lit(n) for s, n in zip(strides(shape), shape))
    return Tensor(base, index, value, shape, dtype_of(dtype))


def tensor(spark: SparkSession, data, dtype: str = "float32") -> Tensor:
    """From nested sequences of one shape; anything ragged raises."""
    dtype = dtype_of(dtype)

    def shape_of(x) -> tuple[int, ...]:
        if not isinstance(x, (list, tuple)):
            return ()
        inner = {shape_of(y) for y in x}
        if len(inner) > 1:
            raise ValueError("shape mismatch")
        return (len(x), *(inner.pop() if inner else ()))

    def flat(x):
        return [z for y in x for z in flat(y)] if isinstance(x, (list, tuple)) else [float(x)]

    shape = shape_of(data)
    base = spark.createDataFrame(list(enumerate(flat(data))), "id bigint, x double")
    index = tuple(_div(F.col("id"), s) % F.lit(n) for s, n in zip(strides(shape), shape))
    return Tensor(base, index, from_double(F.col("x"), dtype), shape, dtype)


def full(spark, shape, value, dtype="float32") -> Tensor:
    return over_range(spark, _shape((shape,) if isinstance(shape, int) else shape), fill(value, dtype_of(dtype)), dtype)


def zeros(spark, *shape, dtype="float32") -> Tensor:
    return full(spark, _shape(shape), 0, dtype)


empty = zeros


def ones(spark, *shape, dtype="float32") -> Tensor:
    return full(spark, _shape(shape), 1, dtype)


def eye(spark, n: int, m: int | None = None, dtype="float32") -> Tensor:
    out = over_range(spark, (n, m or n), None, dtype)
    return replace(out, value=from_double((out.index[0] == out.index[1]).cast("int").cast("double"), out.dtype))


def arange(spark, start: float, end: float | None = None, step: float = 1, dtype="float32") -> Tensor:
    """Half-open; one argument means from 0."""
    if end is None:
        start, end = 0, start
    if step == 0:
        raise ValueError("step must not be zero")
    n = max(0, math.ceil((end - start) / step))
    return over_range(spark, (n,), from_double(F.lit(float(start)) + F.col("id") * F.lit(float(step)), dtype_of(dtype)), dtype)


def linspace(spark, start: float, end: float, steps: int = 100, dtype="float32") -> Tensor:
    """Evenly spaced; float dtypes end exactly at ``end``."""
    if steps <= 0:
        raise ValueError("steps must be positive")
    dtype = dtype_of(dtype)
    step = (end - start) / (steps - 1) if steps > 1 else 0.0
    value = F.lit(float(start)) + F.col("id") * F.lit(float(step))
    if is_float(dtype) and steps > 1:
        value = F.when(F.col("id") == steps - 1, F.lit(float(end))).otherwise(value)
    return over_range(spark, (steps,), from_double(value, dtype), dtype)


def _seed(spark: SparkSession) -> int:
    return int(spark.conf.get("tessera.seed", "0"))


def manual_seed(spark: SparkSession, seed: int) -> None:
    spark.conf.set("tessera.seed", str(seed & 0xFFFFFFFF))


def _random(spark, shape, dtype: str, make) -> Tensor:
    if not is_float(dtype_of(dtype)):
        raise ValueError("random tensors are float32 or float64")
    return _drawn(over_range(spark, _shape(shape), None, dtype), make(_seed(spark)).cast(SPARK_TYPES[dtype_of(dtype)]))


def _drawn(x: Tensor, value: Column) -> Tensor:
    """Random values as a column of the frame, so that each is drawn once."""
    base = x.base.withColumn("x", value)
    return replace(x, base=base, value=F.col("x"))


def rand(spark, *shape, dtype="float32") -> Tensor:
    """Uniform in [0, 1); the seed fixes it for a given number of partitions."""
    return _random(spark, shape, dtype, F.rand)


def randn(spark, *shape, dtype="float32") -> Tensor:
    return _random(spark, shape, dtype, F.randn)


def randint(spark, low: int, high: int | None = None, size: Sequence[int] = (), dtype="int64") -> Tensor:
    """Whole numbers in [low, high); one bound means from 0."""
    if high is None:
        low, high = 0, low
    if low >= high:
        raise ValueError("low must be less than high")
    value = F.floor(F.rand(_seed(spark)) * (high - low)) + F.lit(low)
    return _drawn(over_range(spark, tuple(size), None, dtype), from_double(value.cast("double"), dtype_of(dtype)))


def full_like(other: Tensor, value, dtype: str | None = None) -> Tensor:
    dtype = dtype_of(dtype or other.dtype)
    return replace(other, value=fill(value, dtype), dtype=dtype)


def zeros_like(other: Tensor, dtype: str | None = None) -> Tensor:
    return full_like(other, 0, dtype)


empty_like = zeros_like


def ones_like(other: Tensor, dtype: str | None = None) -> Tensor:
    return full_like(other, 1, dtype)


def from_rows(rows: DataFrame, row: str, array: str, shape: tuple[int, int], dtype: str = "float32") -> Tensor:
    """A matrix whose row number is in column ``row`` and whose row is an array."""
    base = rows.select(F.col(row).cast("bigint").alias("i0"), F.posexplode(array).alias("i1", "v"))
    return Tensor(base, (F.col("i0"), F.col("i1").cast("bigint")), F.col("v").cast(SPARK_TYPES[dtype]), shape, dtype)


def from_columns(table: DataFrame, order: Sequence[str], **columns: str) -> dict[str, Tensor]:
    """Columns of a table as aligned vectors; element-wise work on them needs no join.

    The index is the row's rank under ``order``, counted by ranges.
    """
    from .annotations import ranked

    n = table.count()
    placed = ranked(table, [F.col(c) for c in order]).withColumnRenamed("pos", "__index")
    return {name: Tensor(placed, (F.col("__index"),), F.col(name), (n,), dtype_of(dtype)) for name, dtype in columns.items()}


# -- joining tensors ------------------------------------------------------
def cat(tensors: Sequence[Tensor], dim: int = 0) -> Tensor:
    """Along ``dim``, in the first tensor's dtype."""
    first = tensors[0]
    at = first._dim(dim)
    frames, offset = [], 0
    for x in tensors:
        if x.ndim != first.ndim or any(a != b for k, (a, b) in enumerate(zip(x.shape, first.shape)) if k != at):
            raise ValueError("Shape mismatch")
        moved = replace(x, index=tuple(i + F.lit(offset) if k == at else i for k, i in enumerate(x.index)), value=from_double(x._number(), first.dtype))
        frames.append(moved.cells())
        offset += x.shape[at]
    base = reduce(DataFrame.unionByName, frames)
    return Tensor(base, tuple(F.col(f"i{k}") for k in range(first.ndim)), F.col("v"), tuple(offset if k == at else n for k, n in enumerate(first.shape)), first.dtype)


def stack(tensors: Sequence[Tensor], dim: int = 0) -> Tensor:
    return cat([x.unsqueeze(dim) for x in tensors], dim)


def where(condition: Tensor, a: Tensor, b: Tensor) -> Tensor:
    """``a`` where the condition is not zero, else ``b``, in ``a``'s dtype."""
    if condition.shape != a.shape or a.shape != b.shape:
        raise ValueError("Shape mismatch")
    if condition.base is a.base and a.base is b.base:
        test, x, y = condition, a, b
    else:
        frames = [t.cells().withColumnRenamed("v", name) for t, name in ((condition, "c"), (a, "x"), (b, "y"))]
        keys = [f"i{k}" for k in range(a.ndim)]
        both = reduce(lambda l, r: l.join(r, keys) if keys else l.crossJoin(r), frames)  # without keys each side is one cell
        index = tuple(F.col(k) for k in keys)
        test, x, y = (replace(t, base=both, index=index, value=F.col(name)) for t, name in ((condition, "c"), (a, "x"), (b, "y")))
    return replace(x, value=F.when(test._number() != 0, x.value).otherwise(from_double(y._number(), x.dtype)))
