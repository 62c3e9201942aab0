"""Tensor dtypes, their promotion, and casts that follow tensor rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Narrow to wide; the wider of two operands is the result's.
LATTICE = ("bool", "int32", "int64", "float32", "float64")
SPARK_TYPES = {"bool": "boolean", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}
ALIASES = {"float": "float32", "double": "float64", "int": "int32", "long": "int64"}


def dtype_of(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in LATTICE:
        raise ValueError(f"unknown dtype: {name}")
    return name


def promote(a: str, b: str) -> str:
    """bool < int32 < int64 < float32 < float64, unlike Spark's own rules."""
    return max(dtype_of(a), dtype_of(b), key=LATTICE.index)


def from_double(value: Column, dtype: str) -> Column:
    """A double as ``dtype``: whole numbers are cut toward zero, bool tests for non-zero.

    A value that does not fit raises, NaN and infinity included.
    """
    if dtype == "bool":
        return value != 0
    return value.cast(SPARK_TYPES[dtype])


def to_double(value: Column, dtype: str) -> Column:
    return value.cast("int").cast("double") if dtype == "bool" else value.cast("double")


def is_float(dtype: str) -> bool:
    return dtype in ("float32", "float64")


def fill(value: float | int | bool, dtype: str) -> Column:
    return from_double(F.lit(float(value)), dtype)
